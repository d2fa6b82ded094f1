"""Sources: files as bytes, decoding, listing, validation, languages and include closures."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import LANGUAGE_OF

SYSTEM_HEADER = r"^\s*#\s*include\s*<([^>]+)>"
USER_HEADER = r'^\s*#\s*include\s*"([^"]+)"'


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's folder, or one of our own where none is named."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloupe-"))


def decode_bytes(data: bytes | None) -> tuple[str, str, int]:
    """(text, encoding, line count): a UTF-8 mark, then UTF-8, CP949 and EUC-KR strictly, else CP949 with replacements;
    line breaks become LF; a trailing line break starts no line."""
    data = data or b""
    if data.startswith(b"\xef\xbb\xbf"):
        text, encoding = data[3:].decode("utf-8", "replace"), "utf-8-sig"
    else:
        for encoding in ("utf-8", "cp949", "euc-kr"):
            try:
                text = data.decode(encoding)
                break
            except UnicodeDecodeError:
                continue
        else:
            text, encoding = data.decode("cp949", "replace"), "cp949-replace"
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text, encoding, text.count("\n") + bool(text and not text.endswith("\n"))


def _decode(blobs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(b) for b in blobs], columns=["content", "encoding", "line_count"])


def decode(files: DataFrame, column: str = "content") -> DataFrame:
    """Binary content to content, encoding and line_count."""
    udf = F.pandas_udf(_decode, "struct<content:string,encoding:string,line_count:long>")
    rows = files.withColumn("_d", udf(F.col(column).cast("binary")))
    return rows.select(*[c for c in files.columns if c != column], "_d.*")


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """source_file(path, file_size, last_modified, content, encoding, line_count) of the files under a root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(root).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"), "content")
    return decode(rows)


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """S3: (path, file_size, last_modified) of the files under a root whose names match, by path; a root that isn't a
    folder is an error. Contents aren't read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at) or not system.getFileStatus(at).isDirectory():
        raise NotADirectoryError(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified")).orderBy("path")


def split_glob(pattern: str) -> tuple[str, str]:
    """An absolute pattern to the folder before its first wildcard and the rest; a relative one is under `.`."""
    parts = PurePosixPath(pattern).parts
    if not pattern.startswith("/"):
        return ".", pattern
    at = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts) - 1)
    return str(PurePosixPath(*parts[:at])), str(PurePosixPath(*parts[at:]))


def with_language(files: DataFrame) -> DataFrame:
    """Language by extension, null for others."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return files.withColumn("language", F.try_element_at(table, ext))


def first_line(content: Column) -> Column:
    """S8."""
    return F.substring_index(content, "\n", 1)


def validate(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """requested(seq, path) against listing(path, is_file, readable): the first of equal paths, with a reason where
    it isn't valid."""
    once = requested.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).where("_n = 1").drop("_n")
    rows = with_language(once).join(listing, "path", "left")
    reason = F.when(F.col("is_file").isNull(), "missing").when(~F.col("is_file"), "not a file").when(~F.col("readable"), "not readable").when(F.col("language").isNull(), "unsupported extension")
    return rows.select("seq", "path", "language", reason.alias("reason"))


def resolve_inputs(names: DataFrame, listing: DataFrame) -> DataFrame:
    """names(name) to a path: an equal path, else input/name, else the only path that ends in it; several: ambiguous."""
    paths = listing.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("base"))
    rows = names.withColumn("base", F.regexp_extract("name", r"([^/]+)$", 1)).join(paths, "base", "left")
    rank = F.when(F.col("path") == F.col("name"), 0).when(F.col("path") == F.concat(F.lit("input/"), F.col("name")), 1).when(F.col("path").endswith(F.concat(F.lit("/"), F.col("name"))), 2)
    best = rows.withColumn("_r", rank).groupBy("name").agg(F.min("_r").alias("r"), F.min_by("path", "_r").alias("path"), F.count_if(F.col("_r") == 2).alias("n"))
    return best.select("name", F.when((F.col("r") < 2) | (F.col("n") == 1), F.col("path")).alias("path"), F.when(F.col("r").isNull(), "missing").when((F.col("r") == 2) & (F.col("n") > 1), "ambiguous").alias("error"))


def include_closure(includes: DataFrame, depth: int = 3) -> DataFrame:
    """(file, header, level) reachable from includes(file, header) in `depth` steps, the first level of each: a
    bounded loop of equi joins, with what has been seen taken out by an anti join."""
    known = includes.select("file", "header").distinct().withColumn("level", F.lit(1))
    front = known
    for level in range(2, depth + 1):
        step = front.select("file", F.col("header").alias("via")).join(includes.select(F.col("file").alias("via"), F.col("header").alias("next")), "via")
        front = step.select("file", F.col("next").alias("header")).distinct().join(known.select("file", "header"), ["file", "header"], "left_anti").withColumn("level", F.lit(level))
        known = known.union(front)
    return known


def resolve_headers(sources: DataFrame, includes: DataFrame, files: DataFrame, walk: int = 5, depth: int = 3) -> DataFrame:
    """sources(path) by includes(path, header, is_system) of all files and files(path): (source, header, kind,
    resolved, level). System headers are stubs; others are looked for in the source's folder and `walk` folders above it, the
    nearest first; what isn't found is unresolved. The headers found are followed `depth` levels down, each once for a
    source. A bounded loop of equi joins, each written to the checkpoint folder."""
    ensure_checkpoint_dir(files.sparkSession)
    front = includes.join(sources.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("source"), "header", "is_system").distinct().withColumn("level", F.lit(0))
    out = seen = None
    for level in range(depth + 1):
        system = front.where("is_system").select("source", "header", F.lit("system").alias("kind"), F.lit(None).cast("string").alias("resolved"), "level")
        user = front.where("not is_system").select("source", "header", "level")
        parts = F.slice(F.split("source", "/"), F.lit(1), F.greatest(F.size(F.split("source", "/")) - 1, F.lit(1)))
        steps = F.transform(F.sequence(F.lit(0), F.least(F.lit(walk), F.size(parts) - 1)), lambda k: F.struct(k.alias("k"), F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"), F.lit("/"), F.col("header")).alias("full")))  # noqa: B023
        tries = user.select("source", "header", F.inline(steps))
        hit = tries.join(files.select(F.col("path").alias("full")).distinct(), "full").groupBy("source", "header").agg(F.min_by("full", "k").alias("resolved"))
        rows = user.join(hit, ["source", "header"], "left")
        rows = rows.select("source", "header", F.when(F.col("resolved").isNull(), "unresolved").otherwise("real").alias("kind"), "resolved", "level").checkpoint()
        found = rows.where("kind = 'real'").select("source", "resolved").distinct()
        found = found if seen is None else found.join(seen, ["source", "resolved"], "left_anti")
        seen = found if seen is None else seen.union(found)
        out = system.union(rows) if out is None else out.union(system).union(rows)
        front = found.join(includes.withColumnRenamed("path", "resolved"), "resolved").select("source", "header", "is_system").distinct().withColumn("level", F.lit(level + 1))
    first = out.groupBy("source", "header", (F.col("kind") == "system").alias("stub")).agg(F.min_by(F.struct("kind", "resolved", "level"), "level").alias("f"))
    return first.select("source", "header", "f.kind", "f.resolved", "f.level")


def template(path: str, **values: object) -> str:
    """A text file with {name} filled in; a name without a value is an error."""
    with open(path, encoding="utf-8") as f:
        return f.read().format(**values)


def settings(*paths: str, environment: str | None = None) -> dict:
    """JSON settings, later files over earlier ones, and a file that an environment variable names over all."""
    named = os.environ.get(environment) if environment else None
    out: dict = {}
    for path in (*paths, *([named] if named else [])):
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                out |= json.load(f)
    return out
