"""URL verdicts by path rules and, where none fits, by propagation over the host graph.

Trust starts at hosts whose pages allow rules cover and flows along links (personalised PageRank);
distrust starts at hosts whose pages block rules cover and flows against links (who links there is
suspect): a host takes of each host that it links to the share of its own links that lead there. So
distrust does not thin out over the many hosts that link to a blocked one. Seeds are shares of a host's
pages and not normalised over the corpus, so a score means the same at any size: a fully covered host
without links scores ``1 - damping``. A host is blocked if its distrust reaches ``threshold`` of that and
exceeds its trust; without a rule of its own it must give more than half of its links to blocked hosts,
or nearly all to hosts that do.

Rounds go on until no score of a host moves by more than ``tolerance``; a distrust then differs from its
limit by at most damping / (1 - damping) times that, as each round shrinks the greatest difference by
``damping``. Trust shrinks so in sum, not host by host.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and, as a host
of its own, the verdict of the empty host (allow, as no rule seeds it). Null html has no links. Repeated
rows count again as pages and each get their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.session import written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?is)<a\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, links``: absolute links between different hosts, summed before they are shuffled."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("href"))
    to = F.translate(F.regexp_extract("href", r"//(.+)$", 1), UPPER, LOWER)
    return links.select("src", to.alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, most_rounds: int = 400, cut_every: int = 4) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, trust, distrust)`` over ``edges(src, dst, links)``.

    Both scores travel in one message table, so that a round is one join and one pre-aggregated sum; a
    host with very many neighbours is a skewed join key, which adaptive execution splits. After every
    ``cut_every`` rounds the scores are written and the greatest change is looked at.
    """
    edges = written(edges, "edges")
    start = seeds.select("host", F.col("trust").alias("s_trust"), F.col("distrust").alias("s_distrust"))
    if edges.isEmpty():
        return start.select("host", *((1 - damping) * F.col(f"s_{k}") for k in ("trust", "distrust"))).toDF("host", "trust", "distrust")
    out = edges.groupBy("src").agg(F.sum("links").alias("total")).withColumnRenamed("src", "o_host")
    share = edges.join(out, edges.src == out.o_host).select("src", "dst", (F.col("links") / F.col("total")).alias("share"))
    ahead = share.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("share").alias("w_trust"), F.lit(0.0).alias("w_distrust"))
    back = share.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("w_trust"), F.col("share").alias("w_distrust"))
    moves = written(ahead.union(back).groupBy("at", "to").agg(F.sum("w_trust").alias("w_trust"), F.sum("w_distrust").alias("w_distrust")), "moves")
    hosts = moves.select(F.col("to").alias("host")).distinct().join(start, "host", "full")
    start = written(hosts.select("host", *(F.coalesce(f"s_{k}", F.lit(0.0)).alias(f"s_{k}") for k in ("trust", "distrust"))), "hosts")
    now = start.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    for k in range(1, most_rounds + 1):
        sent = moves.join(now, moves["at"] == now.host).groupBy("to").agg(F.sum(F.col("trust") * F.col("w_trust")).alias("g_trust"), F.sum(F.col("distrust") * F.col("w_distrust")).alias("g_distrust"))
        got = start.join(sent, start.host == sent["to"], "left")
        after = got.select("host", *(((1 - damping) * F.col(f"s_{c}") + damping * F.coalesce(f"g_{c}", F.lit(0.0))).alias(c) for c in ("trust", "distrust")))
        if k % cut_every:
            now = after
            continue
        before = now.select(F.col("host").alias("b_host"), F.col("trust").alias("b_trust"), F.col("distrust").alias("b_distrust"))
        moved = F.greatest(*(F.abs(F.col(c) - F.col(f"b_{c}")) for c in ("trust", "distrust")))
        after = written(after.join(before, F.col("host") == F.col("b_host")).select("host", "trust", "distrust", moved.alias("moved")), f"rank-{k}")
        now = after.drop("moved")
        if after.agg(F.max("moved")).first()[0] <= tolerance:
            return now
    raise RuntimeError(f"scores still move after {most_rounds} rounds")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` for every page; the page text itself is never shuffled."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    share = lambda k: F.avg(F.when(F.col("ruled") == k, 1.0).otherwise(0.0))
    seeds = base.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(pages, url_col, html_col), damping)
    bad = (F.col("distrust") >= threshold * (1 - damping)) & (F.col("distrust") > F.col("trust"))
    scores = scores.select(F.col("host").alias("of"), "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("by_graph"))
    scores = written(scores, "scores")  # its size is known when the join is planned: a small one spares the pages an exchange
    joined = base.join(scores, base.host == scores.of, "left")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("ruled", "by_graph", F.lit("allow")).alias("verdict"), "trust", "distrust")
