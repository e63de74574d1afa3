"""Manuscript relations over the driver tables. The expressions parse in Spark SQL and in DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw texts rarely break a rule, so each document gets fixed sentences that do, varied by its id.
MANUSCRIPTS = """select doc_id,
concat(text, chr(10),
 'Wireless Sensor Network (WSN) nodes span ', cast((doc_id%40+1) as string), '-', cast((doc_id%40+9) as string), ' m and ', cast((doc_id%7+1) as string), '--', cast((doc_id%7+3) as string), ' runs.', chr(10),
 case when doc_id%2=0 then concat('Load is ', cast((doc_id%90+5) as string), 'kg at ', cast((doc_id%50+1) as string), ' % , see [', cast((doc_id%6+1) as string), ',', cast((doc_id%6+2) as string), '] and [2-4].') else 'The QXZ unit , however,was 5ms.' end, chr(10),
 case when doc_id%3=0 then 'The colour and color of a "plain" sign.' when doc_id%3=1 then 'We      analyse “quoted” data.' else 'We analyze "data".  Then stop.' end, chr(10),
 'Fig. ', cast((doc_id%4+1) as string), ' and Table ', cast((doc_id%3+1) as string), ' follow Eq. (', cast((doc_id%5+1) as string), ') and ', case when doc_id%4=0 then 'equation' else 'Eq.' end, ' (', cast((doc_id%5+2) as string), ').', chr(10),
 'References', chr(10),
 '[1] A. Smith, B. Jones, "Deep learning for signals," IEEE Trans. Neural, vol. 3, no. 4, pp. 12-45, 2020, doi: 10.1109/TNN.', cast((2000+doc_id%20) as string), '.1', chr(10),
 '[2] Doe, J. (2019). Title of a work. Journal of Tests, 4(2), 1-9.', chr(10),
 '[', cast((3+doc_id%2) as string), '] Roe AB, Poe CD. Short note. N Engl J Med. 2018;38(5):45-63.') as full_text
from documents"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Bytes of files whose rows may be dealt out anew; larger inputs come in enough splits.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan of a few small files, dealt to all cores: a file of one row group is one task's work, whatever is done to its rows. Larger scans, and those of as many splits as cores, stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    """A SQL query over driver tables, bound by name for this query alone."""
    return spark.sql(query, **{n: load(spark, sf_dir, n) for n in names}) if "{" in query else _bound(spark, sf_dir, query, names)


def _bound(spark: SparkSession, sf_dir: str, query: str, names: tuple[str, ...]) -> DataFrame:
    for n in names:
        query = _from(query, n)
    return spark.sql(query, **{n: spread(load(spark, sf_dir, n)) for n in names})


def _from(query: str, name: str) -> str:
    return re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", query)


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, full_text, body (before the references)."""
    from folioscan.functions.text import body_text

    found = spark.sql(_from(MANUSCRIPTS, "documents"), documents=spread(load(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.withColumn("body", body_text(F.col("full_text")))
