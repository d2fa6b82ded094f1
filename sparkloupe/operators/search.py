"""Line relations, grep, named structural search and rule scanners: one pass over lines, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Named patterns by language; those of SQL and embedded SQL ignore case.
PATTERNS: dict[str, dict[str, str]] = {
    "javascript": {
        "function_def": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\(.*?\)\s*=>))",
        "import": r"(?:import\s+.*?from\s+['\"](.+?)['\"]|require\s*\(\s*['\"](.+?)['\"]\s*\))",
        "class_def": r"class\s+(\w+)",
        "async_function": r"async\s+function\s+(\w+)",
        "event_listener": r"\.addEventListener\s*\(\s*['\"](\w+)['\"]",
        "dom_manipulation": r"(?:innerHTML|outerHTML|document\.write|eval)\s*[=(]",
    },
    "c": {
        "function_def": r"^\s*(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{",
        "include": r"#include\s+[<\"](.+?)[>\"]",
        "malloc": r"\bmalloc\s*\(",
        "free": r"\bfree\s*\(",
        "strcpy": r"\bstrcpy\s*\(",
        "sprintf": r"\bsprintf\s*\(",
    },
    "proc": {
        "exec_sql": r"EXEC\s+SQL\b",
        "include": r"(?:EXEC\s+SQL\s+INCLUDE\s+(\w+)|#include\s+[<\"](.+?)[>\"])",
        "declare_section": r"EXEC\s+SQL\s+(?:BEGIN|END)\s+DECLARE\s+SECTION",
        "sqlca_check": r"sqlca\.sqlcode",
        "cursor_open": r"EXEC\s+SQL\s+OPEN\s+(\w+)",
        "cursor_close": r"EXEC\s+SQL\s+CLOSE\s+(\w+)",
        "commit": r"EXEC\s+SQL\s+COMMIT",
        "rollback": r"EXEC\s+SQL\s+ROLLBACK",
    },
    "sql": {
        "select_star": r"\bSELECT\s+\*",
        "function_in_where": r"WHERE\s+.*?(?:YEAR|MONTH|UPPER|LOWER|TRIM|TO_CHAR|TO_DATE|NVL)\s*\(",
        "like_wildcard": r"LIKE\s+['\"]%",
        "subquery": r"\(\s*SELECT\b",
        "join": r"\bJOIN\b",
        "or_condition": r"\bOR\b",
    },
}
CASELESS = ("sql", "proc")
#: Fixed values: (rule, severity, category, pattern on a line without comments and with empty literals).
C_RULES = (
    ("UNSAFE_FUNC", "high", "memory_safety", r"\b(strcpy|sprintf|strcat|gets|scanf|vsprintf)\s*\("),
    ("BOUNDED_FUNC", "medium", "memory_safety", r"\b(strncpy|memcpy|memset|memmove|snprintf)\s*\("),
    ("MALLOC_NO_CHECK", "high", "null_safety", r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\("),
    ("BUFFER_INDEX", "medium", "memory_safety", r"(\w+)\s*\[\s*([a-zA-Z_]\w*)\s*\]"),
    ("FORMAT_STRING", "high", "security", r"\b(printf|syslog)\s*\(\s*[^\"']"),
)
#: Classes of code patterns by language.
PATTERN_TYPES = ("error_handling", "logging", "memory_management", "transaction")
CODE_PATTERNS = {
    "javascript": {"error_handling": r"(?:try\s*\{|\.catch\s*\(|if\s*\(.*(?:err|error|null|undefined))", "logging": r"console\.(?:log|warn|error|info)\s*\("},
    "c": {"error_handling": r"(?:if\s*\(.*(?:NULL|== -1|< 0)|goto\s+\w+)", "logging": r"(?:printf|fprintf|syslog|log_error)\s*\(", "memory_management": r"\b(?:malloc|calloc|realloc|free)\s*\("},
    "proc": {
        "error_handling": r"(?i)(?:WHENEVER\s+SQLERROR|sqlca\.sqlcode)",
        "logging": r"(?:printf|fprintf|syslog|log_error)\s*\(",
        "memory_management": r"\b(?:malloc|calloc|realloc|free)\s*\(",
        "transaction": r"(?i)EXEC\s+SQL\s+(?:COMMIT|ROLLBACK)",
    },
    "sql": {"transaction": r"(?i)\b(?:COMMIT|ROLLBACK|BEGIN\s+TRANSACTION)\b"},
    "xml": {},
}
#: Words before a parenthesis that aren't calls.
NOT_CALLS = (
    "if for while switch return sizeof typeof catch throw case default else do int void char float double long short unsigned signed struct enum union typedef "
    "const static extern register volatile EXEC SQL BEGIN END DECLARE SECTION SELECT INSERT UPDATE DELETE FROM WHERE OPEN CLOSE FETCH COMMIT ROLLBACK WHENEVER "
    "INCLUDE INTO VALUES SET ORDER GROUP HAVING function class var let import export async await new delete require"
).split()


def source_lines(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """source_line(file_id, line_no, raw): lines count from 1; a trailing line break starts no line."""
    return files.select(F.col(key).alias("file_id"), F.posexplode(T.lines(F.col(content)))).select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("raw"))


def source_files(lines: DataFrame) -> DataFrame:
    """source_file(file_id, content) from source_line, one shuffle by file."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n").alias("content"))


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """The first match of a line: its text, and its start and end from 0, beside the stripped line."""
    found = F.regexp_substr("raw", F.lit(pattern))
    start = F.instr("raw", found) - 1
    return lines.where(F.col("raw").rlike(pattern)).select("file_id", "line_no", F.trim("raw").alias("content"), found.alias("match"), start.cast("long").alias("start"), (start + F.length(found)).cast("long").alias("end"))


def structural_search(lines: DataFrame, language: str | None = None, name: str | None = None, custom: str | None = None) -> DataFrame:
    """Named patterns of a language, one of them, or a custom one: (file_id, line_no, pattern, match, capture): the first
    match of a line and the first of its groups that took part, null for none."""
    if language is not None and language not in PATTERNS:
        raise ValueError(f"no patterns for {language!r}, only for {', '.join(PATTERNS)}")
    wanted = {"custom": custom} if custom else {k: v for k, v in PATTERNS[language or "c"].items() if name in (None, k)}

    def hit(n: str, p: str) -> Column:
        groups = range(1, re.compile(p).groups + 1)
        p = f"(?i){p}" if language in CASELESS else p
        capture = F.coalesce(*[F.nullif(F.regexp_extract("raw", p, i), F.lit("")) for i in groups], F.lit(None).cast("string"))
        return F.when(F.col("raw").rlike(p), F.struct(F.lit(n).alias("pattern"), F.regexp_extract("raw", p, 0).alias("match"), capture.alias("capture")))

    hits = F.filter(F.array(*[hit(n, p) for n, p in wanted.items()]), lambda x: x.isNotNull())
    return lines.select("file_id", "line_no", F.inline(hits))


def rule_hits(code: Column, rules=C_RULES) -> Column:
    """The rules that a line without comments and literals breaks, as an array of (rule_id, severity, category). Every
    rule of C_RULES needs a bracket, so that lines without one aren't searched."""
    hit = lambda r: F.when(code.rlike(r[3]), F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("category")))
    hits = F.filter(F.array(*[hit(r) for r in rules]), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<rule_id:string,severity:string,category:string>>")
    return F.when(code.contains("(") | code.contains("["), hits).otherwise(none) if rules is C_RULES else hits


def scan_rules(lines: DataFrame, rules=C_RULES, code: Column | None = None) -> DataFrame:
    """finding(file_id, line_no, rule_id, severity, category, raw_match): one for each line and rule."""
    rows = lines.withColumn("_code", T.blank_strings(F.col("raw")) if code is None else code)
    return rows.select("file_id", "line_no", F.trim("raw").alias("raw_match"), F.inline(rule_hits(F.col("_code"), rules))).select("file_id", "line_no", "rule_id", "severity", "category", "raw_match")


def line_hits(content: Column, rules=C_RULES) -> Column:
    """scan_rules of a text as an array of (line_no, raw_match, rule_id, severity, category)."""
    found = lambda line, i: F.flatten(F.transform(F.array(T.blank_strings(line)), lambda code: F.transform(rule_hits(code, rules), lambda h: F.struct((i + 1).cast("long").alias("line_no"), F.trim(line).alias("raw_match"), h["rule_id"].alias("rule_id"), h["severity"].alias("severity"), h["category"].alias("category")))))
    return F.flatten(F.transform(T.lines(content), found))


def scan_rules_in_functions(files: DataFrame, rules=C_RULES) -> DataFrame:
    """scan_rules of files(file_id, content) with func_name. A file's findings and spans are made beside each
    other, so there is neither a shuffle nor a join."""
    from .structure import spans_column

    rows = files.select("file_id", spans_column(F.col("content")).alias("_s"), line_hits(F.col("content"), rules).alias("_f"))
    rows = rows.select("file_id", "_s", F.inline("_f"))
    inside = F.get(F.filter("_s", lambda s: F.col("line_no").between(s["line_start"], s["line_end"])), 0)
    return rows.select("file_id", "line_no", "rule_id", "severity", "category", "raw_match", inside["func_name"].alias("func_name"))


def memset_mismatch(lines: DataFrame) -> DataFrame:
    """memset(&v, .., sizeof(T)) where v, without an l_, c_, d_ or s_ prefix, and `_t` isn't T."""
    p = r"\bmemset\s*\(\s*&\s*(\w+)\s*,[^,]*,\s*sizeof\s*\(\s*(\w+)\s*\)"
    v, t = F.regexp_extract("raw", p, 1), F.regexp_extract("raw", p, 2)
    core = F.concat(F.regexp_replace(v, "^[lcds]_", ""), F.lit("_t"))
    return lines.where(F.col("raw").rlike(p)).select("file_id", "line_no", v.alias("variable"), t.alias("size_type")).where(core.substr(F.lit(1), F.length(core)) != "").where(F.concat(F.regexp_replace("variable", "^[lcds]_", ""), F.lit("_t")) != F.col("size_type"))


def unclosed_files(lines: DataFrame) -> DataFrame:
    """Files with more fopen and seq_open calls than fclose and seq_close calls."""
    opened, closed = F.sum(F.regexp_count("raw", F.lit(r"\b(fopen|seq_open)\s*\("))).cast("long"), F.sum(F.regexp_count("raw", F.lit(r"\b(fclose|seq_close)\s*\("))).cast("long")
    return lines.groupBy("file_id").agg(opened.alias("opened"), closed.alias("closed")).where("opened > closed")


def calls(lines: DataFrame) -> DataFrame:
    """call_fact(file_id, name, line_no), distinct; keywords, comment lines and preprocessor lines don't count."""
    names = F.regexp_extract_all("raw", F.lit(r"\b(\w{2,})\s*\("), F.lit(1))
    text = F.regexp_replace("raw", r"^\s+", "")
    rows = lines.where(~text.rlike(r"^(#|//|/\*|\* )")).select("file_id", "line_no", F.explode(F.array_distinct(names)).alias("name"))
    return rows.where(~F.col("name").isin(NOT_CALLS)).distinct()


def imports(lines: DataFrame) -> DataFrame:
    """import_fact(file_id, line_no, target, external) of C and embedded SQL includes and JavaScript imports."""
    p = r"(?i)^\s*(?:#\s*include\s*[<\"]([^>\"]+)|EXEC\s+SQL\s+INCLUDE\s+(\w+)|import\b.*\bfrom\s+['\"]([^'\"]+)|.*\brequire\(\s*['\"]([^'\"]+))"
    target = F.concat(*[F.regexp_extract("raw", p, i) for i in (1, 2, 3, 4)])
    outside = F.col("raw").rlike(r"^\s*#\s*include\s*<") | target.rlike("(?i)^(sqlca|oraca|sqlda)$") | (F.col("raw").rlike(r"\b(import|require)\b") & ~target.startswith("."))
    return lines.where(F.col("raw").rlike(p)).select("file_id", "line_no", target.alias("target"), outside.alias("external"))


def code_patterns(lines: DataFrame, language: str | Column = "proc") -> DataFrame:
    """pattern_fact(file_id, line_no, pattern_type) by the patterns of a language, one for all lines or a column."""
    of = F.lit(language) if isinstance(language, str) else language
    hit = lambda lang, n, p: F.when((of == lang) & F.col("raw").rlike(p), F.lit(n))
    wanted = [hit(lang, n, p) for lang, patterns in CODE_PATTERNS.items() for n, p in patterns.items() if not isinstance(language, str) or lang == language]
    hits = F.filter(F.array(*wanted, F.lit(None).cast("string")), lambda x: x.isNotNull())
    return lines.select("file_id", "line_no", F.explode(hits).alias("pattern_type"))


def pattern_frequencies(facts: DataFrame) -> DataFrame:
    """A5: a count for each file and each of the four types, zero where there is none."""
    return facts.groupBy("file_id").agg(*[F.count_if(F.col("pattern_type") == n).alias(n) for n in PATTERN_TYPES])


def enclosing(rows: DataFrame, spans: DataFrame, line: str = "line_no") -> DataFrame:
    """rows with func_name: the function whose span holds the line, null outside. An equi join by file with a residual
    range, so it is never a nested loop; outermost spans don't overlap, so a row gets one function."""
    s = spans.select(F.col("file_id").alias("_file"), "func_name", "line_start", "line_end")
    return rows.join(s, (rows.file_id == F.col("_file")) & rows[line].between(F.col("line_start"), F.col("line_end")), "left").drop("_file", "line_start", "line_end")
