"""Mixing sources to target weights by systematic sampling.

Targets: the sources' weights share out a total, no source above twice its size; the excess is shared again by weight.
Each document's expected copies (its source's target / size) are prefix-summed within its source; with one random offset
for the source, a document is emitted once for each integer boundary its stretch crosses, so the copies of a source
differ from its share by less than one and no document has more than 2.

That is the rule for all documents; what a document's expected copies are depends on how many words are left to take.
Documents of more than a hundredth of their source, fewer than a hundred of them, come first, largest first, and each one's
expected copies are what is left of the target over what is left of the source (0 to 2). For all others that is the same
number, but for rounding, at whatever point it is taken, so they share one rate. Why words come near their target: the
copies of the first j documents differ from their expected number by less than one, for each j. Summed by parts over
documents in order of size, words taken differ from words expected by less than twice the largest of them, two hundredths
of the source, and what the large ones took too much or too little is in the rate of the others.

Prefix sums are taken in fixed point and in two levels: within buckets of a source (order of magnitude of the size, dealt
to as many places as its documents need), and over the buckets' totals, so a source with a third of all rows is spread over
many tasks.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import batches, ddl, row_key, sized, table, unused

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents of a bucket that are ranked in one place, about.
RANKED = 100_000
#: Documents of more than 1 / LARGE of their source are mixed one by one.
LARGE = 100
#: Fixed point of expected copies.
UNIT = 1 << 24
SEED = "mix-1"


def size_of(text: str | Column = "text") -> Column:
    """Number of words: runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with place: 0, 1, ... in order of code points, null last. Sorted by ranges, so no task holds all sources."""
    key = F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("source"))
    laid = sizes.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_id", F.monotonically_increasing_id())
    laid = table(laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id") - F.shiftleft("_part", 33)).drop("_key", "_id"), "sources")
    starts, before = {}, 0
    for r in laid.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        starts[r["_part"]], before = before, before + r["count"]
    if not starts:
        return laid.select("source", "source_size", F.lit(0).cast("long").alias("place"))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("_part"))
    return laid.select("source", "source_size", (F.col("_at") + start).cast("long").alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target. One row per source, in order of code points, null last; weights repeat in that order.

    Sharing the excess again until no source is above most x its size ends where target = min(most x size, level x weight)
    with one level for all. Each round raises the level by what the sources that are full leave over, until no further one is.
    """
    s = ranked_sources(sizes)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    fills, level = F.col("cap") / F.col("weight"), -1.0
    while True:
        full = fills < level
        r = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap"))).alias("kept"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (share * (r.total or 0) - (r.kept or 0.0)) / r.open if r.open else math.inf
        if now <= level or now == math.inf:
            level = max(now, level)
            break
        level = now
    return s.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def offset(source: Column) -> Column:
    """The one random offset of a source, in fixed point, the same for every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 6), 16, 10).cast("long")


def large_first(rows: DataFrame, most: float) -> DataFrame:
    """Large documents (source, doc_id, row_key, size, source_size, target, offset), fewer than a hundred of a source -> source, doc_id, row_key, nth (of equal rows), copies, and for each source's last one done: (prefix, words taken, words passed) after it."""
    out = batches({"source": pa.string(), "doc_id": pa.int64(), "row_key": pa.int64(), "copies": pa.int64(), "last": pa.bool_(), "prefix": pa.int64(), "taken": pa.int64(), "passed": pa.int64()})

    def take(group):
        rows = sorted(group.to_pylist(), key=lambda r: (-r["size"], r["doc_id"] is not None, r["doc_id"], r["row_key"]))
        prefix, taken, passed, made = rows[0]["offset"], 0, 0, []
        for r in rows:
            step = math.floor(min(max((r["target"] - taken) / (r["source_size"] - passed), 0.0), most) * UNIT)
            copies = ((prefix + step) >> 24) - (prefix >> 24)
            prefix, taken, passed = prefix + step, taken + copies * r["size"], passed + r["size"]
            made.append((r["source"], r["doc_id"], r["row_key"], copies, len(made) + 1 == len(rows), prefix, taken, passed))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*made), out)], schema=out)

    return rows.groupBy("source").applyInArrow(take, ddl(out))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per input row: doc_id, row_key, source, size (words), source_size, target, copies (0 to 2), taken (size x copies).

    Input: doc_id, text, source; other columns are ignored. Null and empty texts have size 0; a null source is a source of
    its own, after the others. Rows that repeat are rows of their own; ties in size are ordered by doc_id, null first. A
    source of size 0 has target 0 and copies 0. Empty in, empty out. Reruns over the same rows give the same copies.
    """
    size = F.col("size")
    magnitude = F.length(size.cast("string")) * 10 + F.substring(size.cast("string"), 1, 1).cast("int")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), row_key().alias("row_key"), size_of().alias("size"))
    each = table(each.withColumn("bucket", magnitude), "sizes")
    buckets = table(each.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "buckets")
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = table(goal.withColumn("offset", offset(F.col("source"))).withColumnRenamed("source", "g_source"), "targets")
    goal = buckets.join(sized(goal), F.col("source").eqNullSafe(F.col("g_source")))
    goal = table(goal.select("g_source", F.col("bucket").alias("g_bucket"), "source_size", "target", "offset", (1 + F.floor(F.col("n") / RANKED)).alias("places")), "goals")
    each = each.join(sized(goal), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("bucket") == F.col("g_bucket"))).drop("g_source", "g_bucket")
    each = each.withColumn("sub", F.pmod(F.xxhash64("doc_id", "row_key"), F.col("places"))).drop("places")
    large = size * LARGE > F.col("source_size")
    first = table(large_first(each.where(large), most), "large")
    ends = table(first.where("last").select(F.col("source").alias("e_source"), "prefix", "taken", "passed"), "ends")
    # Rows that repeat: each takes the next of the copies made for them.
    nth = Window.partitionBy("doc_id", "row_key").orderBy("source")
    made = first.select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), "copies").withColumn("m_nth", F.row_number().over(Window.partitionBy("m_id", "m_key").orderBy("copies")))
    big = each.where(large).withColumn("nth", F.row_number().over(nth)).join(made, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_key") == F.col("m_key")) & (F.col("nth") == F.col("m_nth")))
    rest = each.where(~large)
    totals = table(rest.groupBy("source", "bucket", "sub").agg(F.count("*").alias("n")), "totals")
    before = Window.partitionBy("source").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.col("sub").alias("s_sub"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = table(starts, "starts")
    within = Window.partitionBy("source", "bucket", "sub").orderBy("size", "doc_id", "row_key")
    ranked = rest.withColumn("rank", F.row_number().over(within)).join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")) & (F.col("sub") == F.col("s_sub")))
    ranked = ranked.join(sized(ends), F.col("source").eqNullSafe(F.col("e_source")), "left")
    left = F.col("source_size") - F.coalesce("passed", F.lit(0))
    rate = F.least(F.greatest((F.col("target") - F.coalesce("taken", F.lit(0))) / left, F.lit(0.0)), F.lit(most))
    step = F.when(left > 0, F.floor(rate * UNIT)).otherwise(0).cast("long")
    at, start = F.col("before") + F.col("rank"), F.coalesce("prefix", "offset")
    crossed = F.shiftright(start + at * step, 24) - F.shiftright(start + (at - 1) * step, 24)
    names = ("doc_id", "row_key", "source", "size", "source_size", "target")
    out = big.select(*names, "copies").union(ranked.select(*names, crossed.alias("copies")))
    return out.withColumn("taken", F.col("copies") * size)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, each row as often as mix() takes it. Rows that repeat in doc_id and text are dealt the copies of all of them evenly.

    Null and empty texts, null sources and null doc_ids are as in mix(); documents without words have no copies. Empty in, empty out.
    """
    i, key, total, rows, nth, copy = unused(docs, "m_id", "m_key", "m_copies", "m_rows", "m_nth", "m_copy")
    found = mix(docs, **options).select(F.col("doc_id").alias(i), F.col("row_key").alias(key), "copies")
    found = table(found, "mixed").groupBy(i, key).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    again = not found.where(F.col(rows) > 1).isEmpty()
    own = docs.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(1))) if again else F.lit(1))
    joined = own.join(found, own["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(own["doc_id"], own["text"]) == F.col(key)))
    copies = F.floor(F.col(total) * F.col(nth) / F.col(rows)) - F.floor(F.col(total) * (F.col(nth) - 1) / F.col(rows))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(2)))).where(F.col(copy) <= copies).select(*(own[c] for c in docs.columns))
