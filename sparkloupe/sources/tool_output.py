"""Sources: what lint tools, precompilers and model gateways print, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eslint(outputs: DataFrame) -> DataFrame:
    """outputs(json) to (path, line_no, line_end, rule, level, message); other severities than 1 and 2 don't count."""
    schema = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:long,endLine:long>>>>"
    rows = outputs.select(F.explode(F.from_json("json", schema)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m")).where("m.severity in (1, 2)")
    return rows.select(F.col("filePath").alias("path"), F.col("m.line").alias("line_no"), F.coalesce("m.endLine", "m.line").alias("line_end"), F.col("m.ruleId").alias("rule"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("level"), "m.message")


def clang_tidy(lines: DataFrame) -> DataFrame:
    """lines(raw) to diagnostics; notes and missing headers don't count; severity by the check's prefix."""
    p = r"^(.+?):([0-9]+):([0-9]+): (warning|error): (.*?)(?: \[([^\]]+)\])?$"
    g = lambda i: F.regexp_extract("raw", p, i)
    rows = lines.where(F.col("raw").rlike(p)).select(g(1).alias("path"), g(2).cast("long").alias("line_no"), g(3).cast("long").alias("column_no"), g(4).alias("level"), g(5).alias("message"), g(6).alias("check"))
    severity = F.when(F.col("check").startswith("clang-analyzer-security"), "critical").when(F.col("check").rlike("^(clang-analyzer|bugprone|cert)-"), "high").when(F.col("level") == "error", "high").otherwise("medium")
    return rows.where(~F.lower("message").rlike("file not found|unknown type name|undeclared identifier|no such file")).withColumn("severity", severity)


def precompiler(lines: DataFrame) -> DataFrame:
    """lines(file_id, line_no, raw) to (file_id, line, column, code, message): a code line applies to the next
    position line, each code once; a code line with a colon is a message of its own, too, at the line in brackets or 0."""
    text = F.trim("raw")
    code = F.regexp_extract(text, r"(PCC-[SWE]-[0-9]+)", 1)
    at = lambda i: F.regexp_extract(text, r"(?i)Semantic error at line ([0-9]+),\s*column ([0-9]+)", i)
    alone = r"^(?:PCC-[SWE]-\d+,\s+)?(.+?)(?:\((\d+)\))?:\s*(.+)$"
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select("file_id", "line_no", code.alias("code"), at(1).alias("at"), at(2).alias("column"), text.alias("text")).where("code <> '' or at <> ''")
    rows = rows.withColumn("p", F.last(F.struct("code", "at"), ignorenulls=True).over(w))
    own = F.when(F.col("code") != "", F.col("code")).otherwise(F.when(F.col("p.at") == "", F.col("p.code")))
    placed = rows.where("at <> ''").select("file_id", F.col("at").cast("long").alias("line"), F.col("column").cast("long").alias("column"), own.alias("code"), F.col("text").alias("message"))
    bare = rows.where(F.col("at") == "").where(F.col("text").startswith("PCC-") & F.col("text").rlike(alone))
    group = lambda i: F.regexp_extract("text", alone, i)
    bare = bare.select("file_id", F.coalesce(F.nullif(group(2), F.lit("")).cast("long"), F.lit(0)).alias("line"), F.lit(0).cast("long").alias("column"), "code", F.trim(group(3)).alias("message"))
    return placed.union(bare)


def response_text(lines: DataFrame) -> DataFrame:
    """lines(response_id, seq, raw) of one JSON each: the pieces in order, without a surrounding code fence."""
    j = F.from_json("raw", "token string, choices array<struct<delta:struct<content:string>,text:string>>, error string")
    piece = F.coalesce(j["token"], F.get(j["choices"], 0)["delta"]["content"], F.get(j["choices"], 0)["text"])
    rows = lines.select("response_id", "seq", piece.alias("t"), j["error"].alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("seq", "t")))), lambda x: x["t"]), "")
    return rows.groupBy("response_id").agg(F.regexp_replace(text, r"^\s*```\w*\n|\n?```\s*$", "").alias("text"), F.max("e").alias("error"))
