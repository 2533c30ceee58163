"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Targets: the mix takes ``share`` of all words, dealt to the sources by weight; a target stops at
``most`` times its source's size and the excess is dealt again by weight until none is above (the water
level is found in closed form from the sources sorted by size over weight).

Positions: each source has a schedule, weights at knots over training time 0..1, linear in between. Its
integral, scaled to the source's target, is the source's cumulative demand for words. A source's
documents stand in a fixed pseudo-random order, read again from the start when they run out; the word at
which a copy starts is looked up in the inverse of the demand, which gives the copy's position in time.
The mix is range-sorted by position. A source's last copy is cut where its target ends.

The running sums never gather a source in one task: sizes are first summed in a fixed number of hash
ranges a source, whose running sum is small, then within each range. The order is the hash of id and text, and
of rows equal in both the hash of their number among them as well, so that neither rows without id nor
repeated ones meet in one range. Sums over all sources are taken by ranges of their order too, for there may
be as many sources as domains.

Defined results: null texts have size 0; a null source is a source of its own, last in order; documents
of size 0 take nothing and have no position; repeated rows are documents of their own; an empty table
gives an empty mix. Ties in the order fall to the id, then the size. Columns other than id, text and source
are carried along by ``dealt`` and else not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.session import written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Hash ranges a source (a power of 16), the first hexadecimal digits of the order.
DIGITS = 3
#: Schedules by turns: steady, falling, rising; (time, weight) knots from 0 to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
#: Number of a part file, and of the file within the part.
PART = re.compile(r"part-(\d+)-.*?(?:[-.]c(\d+))\..*")
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, turn, source_size, target`` from ``sizes(source, source_size)``, a row a source.

    Sorted by cap over weight, the full sources are a prefix: with S the caps before and V the weights
    from a source on, (T - S) / V rises up to the first source that does not fill, and falls after it, so
    the level is its maximum.
    """
    n = len(weights)
    s = _before(sizes, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}, "sources")
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % n + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = _before(s, [F.col("cap") / F.col("weight"), F.col("turn")], {"full": F.col("cap"), "passed": F.col("weight")}, "levels")
    every = s.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, weight = float(every.words or 0) * float(share), float(every.weight or 0)
    level = s.agg(F.max((F.lit(total) - F.col("full")) / (F.lit(weight) - F.col("passed")))).first()[0]
    target = F.least(F.col("cap"), F.lit(level).cast("double") * F.col("weight"))
    return s.select("source", "turn", "source_size", target.alias("target"))


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sums over all rows before each in ``order``: by ranges of it, of which the driver holds a row each, then within."""
    spark = rows.sparkSession
    rows = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(k) for k, c in sums.items())).orderBy("_part").collect()
    kinds = {k: rows.select(F.coalesce(F.sum(c), F.lit(0)).alias(k)).schema[k].dataType.simpleString() for k, c in sums.items()}
    starts, held = [], dict.fromkeys(sums, 0)
    for r in totals:
        starts.append((r["_part"], *held.values()))
        held = {k: v + r[k] for k, v in held.items()}
    offsets = spark.createDataFrame([(p, *(float(v) if kinds[k] == "double" else v for k, v in zip(sums, own, strict=True))) for p, *own in starts], ", ".join(["_of int", *(f"_{k} {t}" for k, t in kinds.items())]))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    out = out.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    return out.drop("_part", "_of", *(f"_{k}" for k in sums))


def position_of(drawn: Column, target: Column, schedule) -> Column:
    """Time at which a source's cumulative demand reaches ``drawn`` words: the integral of the schedule inverted.

    Within a knot interval the demand is a parabola; its root is taken in the form that stays exact for level weights.
    """
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    want = F.try_divide(drawn, target) * F.lit(area[-1])
    out = F.lit(1.0)
    for k in reversed(range(len(schedule) - 1)):
        (t0, w0), (t1, w1) = schedule[k], schedule[k + 1]
        need, slope = want - F.lit(area[k]), (w1 - w0) / (t1 - t0)
        root = F.lit(t0) + 2 * need / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))))
        out = F.when(want < F.lit(area[k + 1]), F.least(root, F.lit(t1))).otherwise(out)
    return out


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep: list[str] | None = None) -> DataFrame:
    """A row a document: ``id, size, source_size, target, taken, epochs, last_words, position``; the columns in ``keep`` as ``row``.

    ``taken`` counts words with repeats; ``epochs`` are whole copies, ``last_words`` what a further copy
    gives before the target cuts it; ``position`` is the first copy's, null if nothing is taken.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.encode(text, "UTF-8"))))
    row = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []
    # a name that is never null: null-safe equality would deal the rows out once more for the join
    group = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    base = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), group.alias("group"), key.alias("key"), *row)
    slim = written(base.drop("row"), "sizes")  # without texts: they are counted once
    base = base if keep else slim
    again = slim.groupBy(F.col("group").alias("a_group"), F.col("key").alias("a_key")).count().where("count > 1").drop("count")
    again = written(again, "again")
    if not again.isEmpty():
        same = (F.col("group") == F.col("a_group")) & (F.col("key") == F.col("a_key"))
        numbered = _numbered(base.join(again, same, "left_semi"))
        base = base.join(again, same, "left_anti").unionByName(numbered)
        slim = slim.join(again, same, "left_anti").unionByName(numbered.drop("row"))
    in_range = F.substring("key", 1, DIGITS)
    base = base.withColumn("range", in_range)
    ranges = slim.groupBy("source", "group", in_range.alias("range")).agg(F.sum("size").alias("range_size"))
    ranges = written(ranges, "ranges")
    of_source = written(targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most), "targets")
    ahead = W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    starts = starts.join(of_source, starts.source.eqNullSafe(of_source.source)).select(F.col("group").alias("g"), F.col("range").alias("r"), "range_start", "turn", "source_size", "target")
    inside = W.partitionBy("group", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = base.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, (F.col("group") == F.col("g")) & (F.col("range") == F.col("r")))
    start, size, all_words = F.col("range_start") + F.col("before"), F.col("size"), F.col("source_size")
    goal = F.round("target").cast("long")
    whole = F.coalesce(F.floor(F.try_divide(goal, all_words)), F.lit(0)).cast("long")
    rest = goal - whole * all_words
    last = F.greatest(F.lit(0), F.least(size, rest - start)).cast("long")
    rows = rows.withColumns({"start": start, "epochs": F.when(size > 0, whole).otherwise(0).cast("long"), "last_words": last})
    rows = rows.withColumn("taken", F.col("epochs") * size + F.col("last_words"))
    return rows.withColumn("position", F.when(F.col("taken") > 0, _place(F.col("start"), schedules)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows equal in ``group`` and ``key`` with keys of their own, by their number among them: within the task that read a row, after those of all tasks before."""
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "repeated").withColumn("_task", F.shiftright("_row", 33))
    same = ["group", "key"]
    counts = rows.groupBy(*same, "_task").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*same).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = written(counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "starts")
    number = F.col("_start") + F.row_number().over(W.partitionBy(*same, "_task").orderBy("_row")) - 1
    rows = rows.join(counts, [*same, "_task"]).withColumn("_number", number)
    own = F.when(F.col("_number") > 0, F.md5(F.concat("key", F.lit(":"), F.col("_number").cast("string")))).otherwise(F.col("key"))
    return rows.withColumn("key", own).drop("_row", "_task", "_start", "_number")


def _place(start: Column, schedules) -> Column:
    """The position of the word at ``start`` by the schedule of the row's source."""
    at = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        at = F.when(F.col("turn") % len(schedules) == k, position_of(start, F.col("target"), schedule)).otherwise(at)
    return at


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken, all columns, range-sorted by position.

    Texts stay whole: a copy of which the mix takes half or more is written, one of which it takes less is
    not. Only one document of a source is cut by its target, so that the words written are within half of that
    document's of the target. Documents without words are written once, at the end. A second copy stands one source size of
    words after the first, by its source's schedule.
    """
    rows = plan(docs, id_col, text_col, source_col, keep=docs.columns, **options)
    whole = F.col("epochs") + F.when((F.col("last_words") > 0) & (2 * F.col("last_words") >= F.col("size")), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(whole).cast("int")
    rows = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    later = rows.withColumn("at", F.when(F.col("taken") > 0, _place(F.col("start") + F.col("copy") * F.col("source_size"), options.get("schedules", SCHEDULES))))
    return later.orderBy(F.col("at").asc_nulls_last(), "key", "copy").select("row.*")


def positions(dealt: DataFrame, name: str = "position") -> DataFrame:
    """``dealt`` as it was written and is read again, with each row's place in the mix, from 0.

    Part files are numbered in the order of the mix and hold its rows in order, while readers take files as they
    like. So a row's place is its place in its file, after the rows of all files before; only a count a file
    is gathered. A table that is not read from such files has no ``_metadata`` and is refused.
    """
    spark = dealt.sparkSession
    rows = dealt.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    files = rows.groupBy("_file").count().collect()
    order = {r["_file"]: tuple(map(int, PART.fullmatch(r["_file"]).groups())) for r in files}
    starts, at = [], 0
    for r in sorted(files, key=lambda r: order[r["_file"]]):
        starts.append((r["_file"], at))
        at += r["count"]
    if len(set(order.values())) < len(order):
        raise ValueError("part files of several writes in one folder have no common order")
    begins = F.broadcast(spark.createDataFrame(starts, "_of string, _start long"))
    rows = rows.join(begins, F.col("_file") == F.col("_of"), "left").withColumn(name, F.col("_start") + F.col("_row"))
    return rows.drop("_file", "_row", "_of", "_start")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``id, size, source_size, target, taken, position`` for every document, range-sorted by position."""
    rows = plan(docs, id_col, text_col, source_col, **options)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), id_col)
