"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a file is content-addressed (SHA-256); a blob is scanned once for each version of the rules, whatever
number of paths hold it, and blobs that the ledger has with this rule version aren't scanned again. Texts stay where they
are read: which rows to scan is settled on digests, and only texts with a match are exchanged. Findings are joined back to
all paths. BlobLedger keeps ledger and findings as tables that increments append to. A span's place comes from the lengths of the matches and of the stretches between them, summed up in
a window over the blob's matches, so a text with very many matches costs no more a match than one with few.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, exists, new_folder, table


@dataclass(frozen=True)
class Rule:
    """kind; a Java pattern that matches no empty string; the group that must have least characters; a cheap test of the text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    def may_match(self, text: Column) -> Column:
        found = text.rlike(self.pattern)
        for i, h in enumerate(self.hints):
            has = text.contains(h) if i == 0 else has | text.contains(h)
        return has & found if self.hints else found


# A run of at least 24 hexadecimal digits is what is left of all runs once the shorter ones are dropped; so with AKIA.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",)),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def addressed(versions: DataFrame, paths: list[str]) -> DataFrame:
    """With blob (of null text as of an empty one) and key, which tells the rows that hold a blob apart, but for repeated ones."""
    return versions.select(*paths, "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"), F.xxhash64(*paths).alias("key"))


def rows_to_scan(texts: DataFrame, ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of texts that are in fresh (blob, key), by the smaller of the lists of rows to scan and to leave; neither is broadcast unless it is known to be small."""
    wanted, all_ = fresh.count(), ids.count()
    few = BROADCAST_ROWS // 32
    if 0 <= all_ - wanted <= few < wanted:
        rest = ids.join(fresh, ["blob", "key"], "left_anti")
        rest = table(rest.select("blob", "key").distinct(), "left")
        return texts.join(F.broadcast(rest), ["blob", "key"], "left_anti")
    return texts.join(F.broadcast(fresh) if wanted <= few else fresh, ["blob", "key"], "left_semi")


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text) -> (blob, spans) of blobs with a finding; spans: sorted array of (start, kind as its number in rules, end) in code points."""
    text = F.col("text")
    found = blobs.select("blob", "text", *(r.may_match(text).alias(f"c{i}") for i, r in enumerate(rules)))
    any_ = F.lit(False)
    for i in range(len(rules)):
        any_ = any_ | F.col(f"c{i}")
    found = found.where(any_).dropDuplicates(["blob"])
    arrays = []
    for i, r in enumerate(rules):
        p = F.lit(r.pattern)
        both = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(r.group)), lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
        cut = F.zip_with(F.split(text, r.pattern, -1), both, lambda s, b: F.struct(F.length(s).alias("gap"), b["m"].alias("m"), b["g"].alias("g")))
        arrays.append(F.when(F.col(f"c{i}"), cut).alias(f"a{i}"))
    found = found.select("blob", *arrays)
    each = found.select("blob", F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"a{i}").alias("a")) for i in range(len(rules))))).alias("k"))
    each = each.select("blob", F.col("k.kind").alias("kind"), F.posexplode("k.a").alias("pos", "x")).where("x.m is not null")
    end = F.sum(F.col("x.gap") + F.col("x.m")).over(Window.partitionBy("blob", "kind").orderBy("pos"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    each = each.withColumn("end", end).where(F.col("x.g") >= least)
    return each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("x.m")).alias("start"), "kind", "end"))).alias("spans"))


def scan_unseen(versions: DataFrame, paths: list[str], rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans what ledger(blob, rule_version) lacks. Returns tables: ids (paths, blob, key), what was scanned (blob, rule_version), and its findings (blob, spans, rule_version)."""
    version = rule_version(rules)
    texts = addressed(versions, paths)
    ids = table(texts.drop("text"), "ids")
    # One row of each blob that the ledger lacks.
    fresh = ids.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        fresh = fresh.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    fresh = table(fresh, "fresh")
    new = scan_blobs(rows_to_scan(texts.select("blob", "key", "text"), ids, fresh), rules)
    return ids, fresh.select("blob", F.lit(version).alias("rule_version")), table(new.withColumn("rule_version", F.lit(version)), "findings")


def to_paths(ids: DataFrame, paths: list[str], findings: DataFrame, rules=RULES) -> DataFrame:
    """Every row of ids with the spans of its blob, an empty array if none."""
    now = findings.where(F.col("rule_version") == rule_version(rules)).select(F.col("blob").alias("f_blob"), "spans")
    return ids.join(now, ids["blob"] == now["f_blob"], "left").select(*paths, "blob", F.coalesce("spans", F.array().cast(now.schema["spans"].dataType)).alias("spans"))


def scan(versions: DataFrame, paths: list[str], rules=RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans what ledger(blob, rule_version) lacks. Returns (by_path, ledger, findings), the last two with what is new.

    versions: the columns of paths, and text; others are ignored. Null text counts as empty. by_path has every row of
    versions, repeated ones too, with spans (empty array if none). Empty in, empty out.
    """
    ids, scanned, new = scan_unseen(versions, paths, rules, ledger)
    scanned = ledger.select("blob", "rule_version").union(scanned) if ledger is not None else scanned
    new = findings.select(*new.columns).union(new) if findings is not None else new
    return to_paths(ids, paths, new, rules), scanned, new


STORED = {"blobs": "blob binary, rule_version string", "findings": "blob binary, spans array<struct<start:long, kind:int, end:long>>, rule_version string"}


class BlobLedger:
    """A ledger in a folder that driver and executors share: blobs (blob, rule_version) that were scanned, and their findings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame | None:
        """What all increments so far have stored; None before the first. Each has a folder of its own: Spark takes two reads of one folder for the same, whatever was added between."""
        at = f"{self.folder}/{name}"
        return self.spark.read.schema(STORED[name]).parquet(f"{at}/*") if exists(self.spark, at) else None

    def scan(self, versions: DataFrame, paths: list[str], rules=RULES) -> DataFrame:
        """by_path of scan(): scans what no increment before has scanned with these rules, and appends that.

        Findings are stored before their blobs count as scanned, so an increment that broke off is done again, and a blob
        that was stored twice for that reason is read once. One increment writes at a time.
        """
        ids, scanned, new = scan_unseen(versions, paths, rules, self.read("blobs"))
        increment = uuid.uuid4().hex
        new.write.parquet(f"{self.folder}/findings/{increment}")
        scanned.write.parquet(f"{self.folder}/blobs/{increment}")
        return to_paths(ids, paths, self.read("findings").dropDuplicates(["blob", "rule_version"]), rules)


def joined(spans: Column, rules=RULES) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame, paths: tuple[str, ...] = ("doc_id",), folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Documents are versions at paths, doc_id among their columns. They come in two increments, each document in one of them,
    through a ledger in folder (a new one if not given), so the second scans no blob that the first has scanned, and a later
    call with the same folder none at all that was there before. Null text counts as empty, null paths are paths like
    others, repeated rows each have a row, other columns are ignored. Empty in, empty out.
    """
    ledger = BlobLedger(docs.sparkSession, folder or new_folder(docs.sparkSession, "ledger"))
    second = F.xxhash64("doc_id") < 0
    by_path = ledger.scan(docs.where(~second), [*paths]).union(ledger.scan(docs.where(second), [*paths]))

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    count = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    out = by_path.select(F.col("doc_id").cast("long").alias("doc_id"), *count, joined(F.col("spans")).alias("spans"))
    return out.withColumn("base_sha256", F.sha2("spans", 256))
