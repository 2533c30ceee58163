"""SQL for the operators that SQL can express, as DuckDB runs it over the same tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"'[^\x20\x09-\x0D]+'"

ROUNDS = 80  # changes shrink by 0.85 each: far below what the operator stops at
LINK = r"""'(?is)<a\s(?:[^<>]*?\s)?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"''\s>]+)'"""


def _propagation() -> str:
    """Rules, and the verdicts of rounds written out one by one."""
    rounds = "".join(
        f""",
r{k} as materialized (select h.host, (1 - 0.85::double) * h.t + 0.85::double * coalesce(sum(m.wt * r.t), 0) as t, (1 - 0.85::double) * h.d + 0.85::double * coalesce(sum(m.wd * r.d), 0) as d
  from h left join (m join r{k - 1} r on m.src = r.host) on m.dst = h.host group by h.host, h.t, h.d)"""
        for k in range(1, ROUNDS + 1)
    )
    return f"""
with p as materialized (select row_number() over () as k, page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules (kind, h, q) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (select k, arg_max(h || q, length(h || q)) as rule, arg_max(kind, length(h || q)) as kind from p join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, q) group by k),
g as materialized (select p.*, rule, kind from p left join f on p.k = f.k),
s as (select host, avg(case when kind = 'allow' then 1.0::double else 0.0 end) as t, avg(case when kind = 'block' then 1.0::double else 0.0 end) as d from g group by host),
l as (select host as src, unnest(regexp_extract_all(html, {LINK}, 1)) as href from p),
e as (select src, translate(regexp_extract(href, '//(.+)$', 1), '{UPPER}', '{LOWER}') as dst from l),
w as materialized (select src, dst, count(*) / (sum(count(*)) over (partition by src))::double as share from e where src <> dst and src <> '' group by src, dst),
m as materialized (select src, dst, sum(wt) as wt, sum(wd) as wd from (select src, dst, share as wt, 0.0::double as wd from w union all select dst, src, 0.0::double, share from w) group by src, dst),
h as materialized (select host, coalesce(t, 0) as t, coalesce(d, 0) as d from (select dst as host from m union select host from s) left join s using (host)),
r0 as materialized (select host, t, d from h){rounds}
select page_id, host, path, rule, coalesce(kind, case when d >= 0.5 * (1 - 0.85::double) and d > t then 'block' else 'allow' end) as verdict from g left join r{ROUNDS} using (host)
"""


WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select *, cast(strlen(h) as bigint) as n, max(page_id) over (partition by h) as top from p)
select page_id, n as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> top then top end as refers_to from q
"""

RANGE_JOIN = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where len(embedding) = (select len(embedding) as n from embeddings where len(embedding) > 0 group by 1 order by count(*) desc, n limit 1)),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select vec_id, (select count(*) from links l where l.a = o.vec_id) as n_links, least(vec_id, coalesce((select min(b) from reach r where r.a = o.vec_id), vec_id)) as component_id,
  vec_id <= coalesce((select min(b) from reach r where r.a = o.vec_id), vec_id) as kept from embeddings o
"""

MIX = f"""
with d as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), {WORD})) as bigint) as size, source, md5(coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as k0,
  row_number() over (partition by doc_id, coalesce(text, ''), source) - 1 as copy, case when copy = 0 then k0 else md5(k0 || ':' || cast(copy as varchar)) end as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
o as (select *, row_number() over (order by source nulls last) - 1 as turn from s),
w as (select *, cast([3, 1, 2][turn % 3 + 1] as double) as weight, source_size * 2.0::double as cap from o),
l as (select *, ((select sum(source_size) from s) * 1.5::double - coalesce(sum(cap) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, turn rows between current row and unbounded following) as level from w),
t as (select source, turn, source_size, least(cap, (max(level) over ()) * weight) as target from l),
c as (select d.doc_id, d.size, t.*, cast(round(target) as bigint) as goal,
  cast(coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then goal // source_size else 0 end as epochs from c),
r as (select *, case when size > 0 then epochs else 0 end * size + greatest(0, least(size, goal - epochs * source_size - start)) as taken, start / nullif(target, 0) as want from e),
p as (select *, case turn % 3 when 0 then want when 1 then 2 * want / (1.5 + sqrt(greatest(2.25 - 2 * want, 0)))
  else case when want < 0.3125 then 2 * want / (0.25 + sqrt(0.0625 + 3 * want)) else 0.5 + 2 * (want - 0.3125) / (1.0 + sqrt(1 + 3 * (want - 0.3125))) end end as pos from r)
select doc_id, size, source_size, round(target, 6) as target, cast(taken as bigint) as taken, case when taken > 0 then round(case when want < 1 then least(pos, 1.0) else 1.0 end, 9) end as position from p
"""

PREFIX_JOIN = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
t as (select doc_id, len(s) as n, unnest(s) as t from s),
c as (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as i from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by all),
links as (select a, b from c where 100 * i >= 75 * (n + m - i) union all select b, a from c where 100 * i >= 75 * (n + m - i)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
root as (select a, min(b) as b from reach group by 1)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id from s left join root on s.doc_id = root.a
"""

SQL = {"op1_link_propagation": _propagation(), "op5_warc_salvage": WARC, "op6_metric_range_join": RANGE_JOIN, "op7_curriculum_mix": MIX, "op9_grouped_prefix_join": PREFIX_JOIN}
