"""Documents that arrive over time: each is checked by itself, so no state and no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.functions.text import body_text
from folioscan.operators import text_checks


def arriving(spark: SparkSession, path: str, schema: str = "doc_id long, text string", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def check_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, checks: tuple[str, ...] = ("en_dash_ranges",)) -> StreamingQuery:
    """Runs checks over each micro-batch of docs(doc_id, text) and hands the violations to sink(rows, batch_id)."""

    def each(batch: DataFrame, number: int) -> None:
        docs = batch.select("doc_id", body_text(F.col("text")).alias("body"))
        out = None
        for name in checks:
            rows = text_checks.run(text_checks.CHECKS[name], docs)
            out = rows if out is None else out.unionByName(rows)
        sink(out, number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
