"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger holds the findings of each (blob, rule
version) that has been scanned; a scan reads only pairs that it lacks, appends them, and joins findings back to all
paths and versions of the blob.

Scale: blobs are made distinct before their texts are shuffled, combined on the map side, so a text with very many
copies moves once a task; the anti join with the ledger reuses that partitioning. Scanning is expressions only.
Findings are joined back by blob, small rows on both sides; AQE splits a hot blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace
from ._spans import SPANS, guarded, joined, redact

#: The rules. (kind, pattern, group whose length counts, least length, guard pattern or None)
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further formats that issuers document.
ADDED = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("dsn", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/:@]{1,200}@", 0, 0),
)
MARK = "[SECRET]"
#: The setting that names the path of a lasting ledger.
LEDGER = "spark.sparkloupe.secrets.ledger"
RULES = hashlib.sha256(repr((BASE, ADDED)).encode()).hexdigest()[:16]
FOUND = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def find(text: Column) -> Column:
    """All spans of a text, sorted by start and then kind as listed; base kinds have rank 0 to 2."""

    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        keep = (lambda s: F.char_length(F.regexp_extract(s["match"], pattern, group)) >= least) if group else None
        return guarded(text, text.rlike(pattern), pattern, kind, rank, keep)

    spans = F.concat(*(of(i, *rule) for i, rule in enumerate(BASE + ADDED)))
    bare = F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"]))
    return F.array_sort(bare).cast(FOUND)


class Ledger:
    """A Parquet table of (blob, findings), partitioned by rule version, in the shared folder. Appends only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, rules: str = RULES) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rules={rules}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        schema = f"blob string, findings {FOUND}"
        found = self.spark.read.schema(schema).parquet(f"{self.path}/rules={rules}") if there else self.spark.createDataFrame([], schema)
        return found.dropDuplicates(["blob"]) if there else found  # a retried or overlapping scan appends a blob twice, with equal findings

    def unseen(self, versions: DataFrame, rules: str = RULES) -> DataFrame:
        """(blob, text), one row for each blob of versions(blob, text) that these rules haven't scanned."""
        return versions.select("blob", "text").dropDuplicates(["blob"]).join(self.read(rules).select("blob"), "blob", "left_anti")

    def scan(self, versions: DataFrame, rules: str = RULES) -> DataFrame:
        """Scan what is unseen, append it, and return the ledger of these rules."""
        fresh = self.unseen(versions, rules).select("blob", find(F.col("text")).alias("findings"))
        fresh.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/rules={rules}")
        return self.read(rules)


def addressed(docs: DataFrame) -> DataFrame:
    """docs with columns blob and text (null: empty) for scanning, all in a struct `row` beside them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan(spark: SparkSession, docs: DataFrame, ledger: Ledger) -> DataFrame:
    """(row, blob, findings) for each row of docs(text, ...). Null texts are empty; equal texts share one scan;
    repeated rows stay; a text without a secret has an empty array."""
    rows = addressed(docs)
    known = ledger.scan(rows.select("blob", "text"))
    return rows.select("row", "blob").join(known, "blob", "left")


def redacted(spark: SparkSession, docs: DataFrame, name: str = "secrets") -> DataFrame:
    """docs with every secret in `text` replaced by MARK, and n_chars, if there, counted anew. Null texts stay null."""
    ledger = ledger_of(spark, name)
    rows = addressed(docs)
    known = ledger.scan(rows.select("blob", "text")).where(F.size("findings") > 0)
    text = F.when(F.col("row.text").isNull(), F.lit(None)).when(F.col("findings").isNull(), F.col("row.text")).otherwise(redact(F.col("row.text"), F.col("findings"), MARK))
    out = rows.drop("text").join(known, "blob", "left").withColumn("clean", text)
    size = F.when(F.col("findings").isNull(), F.col("row.n_chars")).otherwise(F.char_length("clean").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None
    return out.select(*(F.col("clean").alias("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns))


def ledger_of(spark: SparkSession, name: str) -> Ledger:
    """The ledger at the path that LEDGER names in the session, which outlives it, so that a later run scans only new
    blobs; a new one in the shared folder where it names none."""
    return Ledger(spark, spark.conf.get(LEDGER, None) or Workspace(spark, name).path("ledger"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of documents. Null texts are empty, repeated
    rows stay, and a text without a secret has no span."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = ledger_of(spark, "op8")
    rows = scan(spark, docs, ledger)
    base = F.filter("findings", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("findings", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)]  # noqa: B023
    return rows.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _oracle() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE + ADDED):
        keep = f"length(regexp_extract(found[i], $re${pattern}$re$, {group})) >= {least}" if group else "true"
        parts.append(f"""
            select doc_id, {rank} as rank, '{kind}' as kind, start, start + length(found[i]) as stop from (
                select *, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::bigint as start
                from (select doc_id, unnest(range(1, len(found) + 1)) as i, found, pieces from (
                    select doc_id, regexp_extract_all(text, $re${pattern}$re$) as found, string_split_regex(text, $re${pattern}$re$) as pieces from documents where text is not null)))
            where {keep}""")
    counts = ", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind, *_ in BASE)
    line = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)"
    return f"""
        with found as ({" union all ".join(parts)}),
        per as (select doc_id, {counts}, coalesce({line} filter (rank < {len(BASE)}), '') as base, {line} as spans from found group by doc_id)
        select d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind, *_ in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from documents d left join per on per.doc_id = d.doc_id"""


ORACLE = _oracle()
