"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample (FIT_ROWS vectors) makes balanced 64-bit codes whose Hamming distance follows the
angle. TABLES windows of each code, evenly spaced around it, are the keys of as many hash tables; a pair is retrieved if
a window differs in at most one bit (two from WIDE bits on) and the codes in at most RADIUS bits, and is then reranked by
the cosine of the original vectors in double precision. Windows have as many bits as the largest label has powers of two,
so buckets stay small at any size; they overlap when wider than the space between them, so there are as many at any width.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, as_long, batches, connected_components, ddl, emit, table

FIT_ROWS, BITS, RADIUS, LIMIT = 4096, 64, 18, 0.93
TABLES, WIDE = 8, 16


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """(dimension, bits) projection of unit rows x: principal axes, then the rotation that brings the rows nearest to their signs. Fewer dimensions than bits: several rotations side by side."""
    rng, d = np.random.RandomState(seed), x.shape[1]
    axes = np.linalg.eigh(x.T @ x / max(1, len(x)) + 1e-9 * np.eye(d))[1][:, ::-1]
    out = []
    while sum(w.shape[1] for w in out) < bits:
        c = min(d, bits - sum(w.shape[1] for w in out))
        w = axes[:, :c]
        v, r = x @ w, np.linalg.qr(rng.randn(c, c))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ t).T
        out.append(w @ r)
    return np.concatenate(out, 1)


def vectors_of(b: pa.RecordBatch) -> list[np.ndarray | None]:
    """Vectors as doubles; None for those that are null, empty, zero, or hold null or non-finite components."""
    out = []
    for v in b.column("embedding").to_pylist():
        x = None if not v or any(c is None for c in v) else np.array(v, float)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def encode(vectors: DataFrame, rotations: dict[int, np.ndarray]) -> DataFrame:
    """One row per vector: vec_id, row (its number), label, dim, same (128 bits that tell label and vector), code, unit. same is null for vectors that link with nothing."""
    out = batches({"vec_id": pa.int64(), "label": pa.int64(), "dim": pa.int32(), "same": pa.binary(), "code": pa.int64(), "unit": pa.binary()})

    def run(it: Batches) -> Batches:
        for b in it:
            rows = []
            for x, label in zip(vectors_of(b), b.column("label").to_pylist()):
                if x is None or label is None:
                    rows.append((0, None, None, None))
                    continue
                u = unit(x)
                code = np.packbits(u @ rotations[len(x)] >= 0).view(">u8").astype(np.uint64)
                same = xxhash.xxh3_128_digest(np.int64(label).tobytes() + (x + 0.0).tobytes())
                rows.append((len(x), same, as_long(code)[0], u.tobytes()))
            if rows:
                yield emit(out, b.column("vec_id"), b.column("label"), *map(list, zip(*rows)))

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, ddl(out)).withColumn("row", F.monotonically_increasing_id())


def rotations_of(vectors: DataFrame, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """A rotation for each dimension that occurs, from at most rows vectors of all."""
    dims = [r.d for r in vectors.select(F.size("embedding").alias("d")).where("d > 0").distinct().collect()]  # as many as there are dimensions
    sample = vectors.select("vec_id", "embedding").where("size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow()
    found: dict[int, list] = {d: [] for d in dims}
    for b in sample.to_batches():
        for x in vectors_of(b):
            if x is not None:
                found[len(x)].append(unit(x))
    return {d: learn_rotation(np.array(x).reshape(-1, d)) for d, x in found.items()}


def candidates(classes: DataFrame, largest: int) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, of one label and dimension, within a bit in some window, or two if windows are wide, and RADIUS bits in all."""
    width = min(22, max(8, math.ceil(math.log2(max(2, largest)))))
    code = F.col("code")
    # A window runs on from the code's end to its start.
    cut = [F.struct(F.lit(t).alias("chunk"), F.shiftrightunsigned(code, at).bitwiseOR(F.shiftleft(code, (BITS - at) % BITS)).bitwiseAND((1 << width) - 1).alias("value")) for t, at in enumerate(range(0, BITS, BITS // TABLES))]
    cut = classes.select("node", "label", "dim", "code", F.explode(F.array(*cut)).alias("c")).select("node", "label", "dim", "code", "c.*")
    flips = F.array(*(F.lit(x).cast("long") for x in [0, *(1 << i for i in range(width))]))
    probe = cut.withColumn("flip", F.explode(flips)).withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    index = probe if width >= WIDE else cut.withColumn("flip", F.lit(0).cast("long"))  # both sides a bit off: two bits between them
    probe = probe.select(*(F.col(c).alias(f"p_{c}") for c in probe.columns))
    same = (F.col("label") == F.col("p_label")) & (F.col("dim") == F.col("p_dim")) & (F.col("chunk") == F.col("p_chunk")) & (F.col("value") == F.col("p_value"))
    once = (F.col("flip") < F.col("p_flip")) | (F.col("p_flip") == 0) & (F.col("flip") == 0)  # of the ways a pair can meet in a table
    near = (F.col("node") < F.col("p_node")) & once & (F.bit_count(code.bitwiseXOR(F.col("p_code"))) <= RADIUS)
    return index.join(probe, same & near).select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct()


def rerank(pairs: DataFrame, classes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The pairs whose cosine is at least limit."""
    both = pairs.join(classes.select(F.col("node").alias("a"), F.col("unit").alias("u"), F.col("n").alias("na")), "a").join(classes.select(F.col("node").alias("b"), F.col("unit").alias("v"), F.col("n").alias("nb")), "b")
    out = batches({"a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64()})

    def run(it: Batches) -> Batches:
        for x in it:
            ok = [float(np.frombuffer(u) @ np.frombuffer(v)) >= limit for u, v in zip(x.column("u").to_pylist(), x.column("v").to_pylist())]
            yield x.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "na", "nb", "u", "v").mapInArrow(run, ddl(out))


def link_vectors(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id in reach), kept.

    Input: vec_id, embedding, label; other columns are ignored. Rows link if their labels are equal, and their vectors as
    long, with a cosine of at least limit. Vectors that are null, empty, zero or hold null or non-finite components, and null
    labels, link with nothing: n_links 0, component_id their own vec_id. Equal vectors of a label are one class that links
    within itself. Rows that repeat are rows of their own. A null vec_id never names a component unless all of it are null.
    """
    each = table(encode(vectors, rotations_of(vectors)), "codes")
    # A class is named after the first of its rows, so no two classes share a name.
    named = each.where("same is not null").groupBy("same", "label", "dim").agg(F.min("row").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("code").alias("code"), F.first("unit").alias("unit"))
    classes = table(named, "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    links = table(rerank(table(candidates(classes, largest), "candidates"), classes, limit), "links")
    ends = links.select(F.col("a").alias("node"), F.col("nb").alias("m")).union(links.select("b", "na"))
    degree = ends.groupBy("node").agg(F.sum("m").alias("m"))
    component = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "node")
    named = classes.select("node", "rep", "n").join(degree, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = table(named, "named")
    least = table(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = named.join(least, "component").join(classes.select("node", F.col("same").alias("c_same")), "node")
    named = table(named.select("c_same", "component_id", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("links")), "final")
    alone = F.col("same").isNull()
    out = each.join(named, each["same"] == named["c_same"], "left").select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
