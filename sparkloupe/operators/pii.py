"""Personal-data and secret detection by ordered rules, with places, and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import SPANS, matches, starred

#: Family names in the Latin alphabet, and prefixes of business numbers.
SURNAMES = "Kim|Lee|Park|Choi|Jung|Jang|Cho|Kang|Lim|Han|Yoon|Jeon|Shin|Kwon|Hwang|Ahn|Hong|Yang|Bae|Baek|Hur|Nam|Seong|Sim|Yuk|Gil|Heo|Pyo|Yeo|Chae|Noh|Joo|Koo"
PREFIXES = "1533|1544|1555|1566|1577|1588|1599|1600|1644|1661|1666|1670|1688|1800|1855|1877|1899"
#: Rules in order of priority (code, severity, pattern, on masked text, check).
RULES = (
    ("foreigner_registration", "high", r"(?U)\b\d{6}[-][5-8]\d{6}\b", True, None),
    ("resident_registration", "critical", r"(?U)\b\d{6}[-]\d{7}\b", True, None),
    ("phone", "high", r"(?U)\b(?:01[016789]|02|0[3-9]\d)[-\s]?\d{3,4}[-\s]?\d{4}\b", True, None),
    ("card", "high", r"(?U)\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b", True, None),
    ("passport", "high", r"(?U)\b[A-Z]{1,2}\d{7,8}\b", True, None),
    ("driver_licence", "high", r"(?U)\b\d{2}[-]\d{2}[-]\d{6}[-]\d{2}\b", True, None),
    ("business_number", "medium", rf"(?U)\b(?:{PREFIXES})[-\s]?\d{{4}}\b", False, None),
    ("safety_number", "high", r"(?U)\b0507[-\s]?\d{3,4}[-\s]?\d{4}\b", False, None),
    ("email", "medium", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False, None),
    ("imsi", "critical", r"(?U)\b450\d{12}\b", False, None),
    ("iccid", "critical", r"(?U)\b89\d{17,19}\b", False, None),
    ("imei", "critical", r"(?U)\b\d{15}\b", False, "luhn"),
    ("romanised_name", "medium", rf"(?U)\b(?:{SURNAMES})[\s.-][A-Z][a-z]{{2,6}}(?:[\s.-][A-Z]?[a-z]{{2,6}})?\b", False, None),
    ("romanised_name", "medium", rf"(?U)\b[A-Z][a-z]{{2,6}}[\s.-](?:{SURNAMES})\b", False, None),
)
#: Secrets in formats that their issuers document.
SECRETS = (
    ("aws_key", "critical", r"\bAKIA[0-9A-Z]{16}\b", False, None),
    ("github_token", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36,}", False, None),
    ("jwt", "high", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False, None),
    ("google_key", "critical", r"\bAIza[0-9A-Za-z_-]{35}", False, None),
    ("stripe_key", "critical", r"\b[rs]k_live_[0-9A-Za-z]{16,}", False, None),
    ("password", "high", r"(?i)\b(?:password|passwd|pwd|token|secret)\s*[:=]\s*[\"'][^\"'\s]{4,}[\"']", False, None),
    ("db_url", "high", r"(?i)\b(?:postgres|postgresql|mysql|oracle|mongodb)://[^\s:/@]+:[^\s@]+@[^\s]+", False, None),
)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def findings(text: Column, rules=RULES) -> Column:
    """array<struct(start, end, prio, rule, severity, value)> by rule and place: identical spans once, by the first rule;
    overlapping unequal ones all stay; values whose long digit groups are a digit and zeros are masked data and don't
    count. Null for a null text."""

    def every(masked: Column) -> Column:
        parts = []
        for i, (code, severity, pattern, on_masked, check) in enumerate(rules):
            spans = matches(masked if on_masked else text, pattern)
            value = lambda s: F.substring(text, s["start"] + 1, F.length(s["match"])) if on_masked else s["match"]  # noqa: E731, B023
            if check == "luhn":
                spans = F.filter(spans, lambda s: F.call_function("luhn_check", s["match"]))
            parts.append(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), F.lit(i).alias("prio"), F.lit(code).alias("rule"), F.lit(severity).alias("severity"), value(s).alias("value"))))  # noqa: B023
        return F.concat(*parts)

    def once(found: Column) -> Column:
        runs = lambda s: F.regexp_extract_all(s["value"], F.lit("[0-9]{6,}"), F.lit(0))
        real = F.filter(found, lambda s: ~(s["value"].rlike("[0-9]{6}") & F.forall(runs(s), lambda g: g.rlike("^[0-9]0*$"))))
        first = _let(real, lambda a: F.filter(a, lambda s: ~F.exists(a, lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["prio"] < s["prio"]))))
        return F.when(F.size(found) > 0, first).otherwise(found)

    masked = F.when(text.rlike("[0-9]{6}"), T.mask_digits(text, 6)).otherwise(text)
    return F.when(text.isNotNull(), _let(_let(masked, every), once))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """finding(doc_id, rule, severity, start, end, value). One row's findings are made together, so there is no
    shuffle. Null texts have none."""
    rows = docs.select("doc_id", F.explode(findings(F.col("text"), rules)).alias("f"))
    return rows.select("doc_id", "f.rule", "f.severity", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.value")


def file_scan(files: DataFrame, rules=RULES) -> DataFrame:
    """The findings of files(file_id, content) with line and column from 1, the line cut at 120 characters, and the
    value masked for display."""
    rows = files.select("file_id", "content", F.explode(findings(F.col("content"), rules)).alias("f"))
    before = F.substring("content", F.lit(1), F.col("f.start"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    snippet = F.left(F.trim(F.get(F.split("content", "\n", -1), line - 1)), F.lit(120))
    return rows.select("file_id", "f.rule", "f.severity", line.cast("long").alias("line_no"), column.cast("long").alias("column_no"), snippet.alias("code"), display_mask(F.col("f.value")).alias("shown"))


def display_mask(value: Column) -> Column:
    """Up to four characters all hidden; else the first quarter, two at least, is shown."""
    shown = F.greatest(F.lit(2), F.floor(F.length(value) / 4)).cast("int")
    return F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value))).otherwise(F.rpad(F.left(value, shown), F.length(value), F.lit("*")))


def centre_mask(value: Column) -> Column:
    """The middle character hidden, or the middle two."""
    n = F.length(value)
    k = F.when(n % 2 == 1, 1).otherwise(2)
    start = F.floor((n - k) / 2).cast("int") + 1
    return F.when(n == 0, value).otherwise(F.overlay(value, F.repeat(F.lit("*"), k), start, k))


def masked_text(text: Column, rules=RULES + SECRETS) -> Column:
    """Every span of every rule replaced by as many asterisks."""
    spans = F.concat(*[F.transform(matches(text, rule[2]), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("stop"))) for rule in rules])
    return _let(spans, lambda s: starred(text, s))


def positions(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Line and column, both from 1, of findings in docs(doc_id, text)."""
    before = F.substring("text", F.lit(1), F.col("start").cast("int"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return findings.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "rule", "start", line.cast("long").alias("line_no"), column.cast("long").alias("column_no"))


def first_rule_per_span(findings: DataFrame, priority: Column) -> DataFrame:
    """The same first-rule rule over rows from several scans."""
    w = Window.partitionBy("doc_id", "start", "end").orderBy(priority)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
