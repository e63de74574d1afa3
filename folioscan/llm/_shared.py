"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources.manuscripts import spread

#: Rows of one long column that may be broadcast (about 32 MB); a longer list is joined by shuffling.
BROADCAST_ROWS = 4_000_000
#: Removes the shuffle files of a query as soon as it ends; else they stay until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of tables that this process wrote and nobody has deleted.
written: list[str] = []
#: Edges whose components one task finds (16 MB); more take rounds of exchanges.
EDGES = 1_000_000
#: Rows of whole texts that pass to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscan-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/folioscan/{name}-{uuid.uuid4().hex}"
    written.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives a lost executor. What was shuffled for it goes at once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    bound_batches(spark)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables of table() that nothing reads any more: what was made of them is a table itself."""
    for t in tables:
        remove(t.sparkSession, t.folder)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in written:
        written.remove(path)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables at paths. For a caller that has written what it made of them."""
    for path in paths:
        remove(spark, path)


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch: they hold whole texts, and both the JVM and the Python worker hold a batch several times."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in pc.cast(batch.column(name), pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def as_long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def row_key() -> Column:
    """With doc_id, tells rows of documents apart, but for rows that repeat in both."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has such columns."""
    taken = {c.lower() for c in df.columns}
    return [next(x for i in range(len(taken) + 1) if (x := n + "_" * i).lower() not in taken) for n in names]


def by_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs left semi or anti the (doc_id, row_key) rows of keys. keys is broadcast only after a check of its size."""
    few = keys.count() <= BROADCAST_ROWS // 8
    i, key = unused(docs, "k_id", "k_key")
    k = keys.select(F.col("doc_id").alias(i), F.col("row_key").alias(key))
    k = F.broadcast(k) if few else k
    return docs.join(k, F.col(i).eqNullSafe(docs["doc_id"]) & (F.col(key) == F.xxhash64(docs["doc_id"], docs["text"])), how)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS // 8) -> DataFrame:
    """df, a table, to be broadcast if it has at most so many rows; beyond, Spark joins by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def only(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in keys, a table. keys is broadcast only after a check of its size."""
    k = keys.select(column)
    return df.join(F.broadcast(k) if k.count() <= BROADCAST_ROWS // 8 else k, column, "left_semi")


def parts_for(rows: int) -> int:
    """Parts, by hashes, of a list of so many rows that leave each part short enough to broadcast; one where nothing is broadcast."""
    most = BROADCAST_ROWS // 8 * 4 // 5
    return max(1, -(-rows // most)) if most > 0 else 1


def members(ids: DataFrame, column: str) -> np.ndarray | None:
    """Sorted values of a long column if they are few enough to broadcast, else None."""
    if ids.count() > BROADCAST_ROWS:
        return None
    got = [np.frombuffer(b"", np.int64)]
    got += [c.to_numpy() for c in ids.select(column).toArrow().column(0).chunks]
    return np.sort(np.concatenate(got).astype(np.int64))


def has(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array found."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id in reach) of the ids of edges."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return ids, ids[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]


def components_at_once(edges: DataFrame) -> DataFrame:
    """connected_components() of a table of at most EDGES edges, in one task."""
    out = batches({"id": pa.int64(), "component": pa.int64()})

    def run(it: Batches) -> Batches:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in it if b.num_rows]
        if held:
            yield emit(out, *parts_of(*map(np.concatenate, zip(*held))))
        trim()

    return edges.select("u", "v").coalesce(1).mapInArrow(run, ddl(out))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges(u, v) of longs -> (id, component) for every id of an edge; component is the smallest id in reach.

    Up to EDGES edges, counted, one task finds them. Beyond, it alternates large-star and small-star steps. The smallest neighbours are tables of their own: broadcast if they are few,
    else both sides of the join are exchanged for it and a hub with very many neighbours is split by adaptive execution.
    """

    def step(e: DataFrame, both: bool) -> DataFrame:
        pairs = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        found = table(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        least = sized(found)
        near = pairs.where("v > u") if both else pairs
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            out = out.union(least.select("u", F.col("m").alias("v")))
        out = table(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        free(found, e)
        return out

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.count() <= EDGES:
        return components_at_once(e)
    before = mark(e)
    for _ in range(rounds):
        if not before[0]:
            break
        e = step(step(e, True), False)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def batches(columns: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(columns.items()))


def emit(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(i).type) for i, x in enumerate(columns)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


Batches = Iterator[pa.RecordBatch]
