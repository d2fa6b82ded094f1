"""Structure of source files: function spans, embedded SQL regions and what they hold.

Spans and regions come from sequential automata, one file at a time in Arrow batches and without a shuffle; the
relations made of them are ordinary DataFrames.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DECL = re.compile(r"^\s*(?!typedef\b|struct\b|#)(?:[A-Za-z_][\w]*[\s*]+)+([A-Za-z_]\w*)\s*\([^;]*$")
#: A line with nothing but a type, whose function's name is on the next.
_TYPE = re.compile(r"^\s*(?:static\s+|extern\s+|inline\s+)*(?:void|int|char|long|short|unsigned|float|double|size_t|ssize_t|\w+_t)\s*\*?\s*$")
_CONTROL = re.compile(r"\b(if|else|for|while|switch|return|do|case|sizeof|EXEC)\b")
_JS = re.compile(r"^\s*(?:(?:async\s+)?function\s+([\w$]+)\s*\(|(?:(?:var|let|const)\s+)?([\w$.]+)\s*=\s*(?:async\s+)?function\b)")
_BRACE = re.compile(r"[{}]")
_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|//.*$')
#: Names of functions that every program of the framework has.
BOILERPLATE = re.compile(r"^(?:main|z\w{3}b\w+\d+)$|_(?:init|exit)_proc$", re.I)


def spans_of(text: str, language: str = "c") -> list[tuple]:
    """(name, first line, last line, signature, boilerplate), outermost and in order; an unmatched candidate gives way
    to the next line. Braces in block comments count, those in literals and after // don't."""
    rows = text.split("\n")
    braces = ["".join(_BRACE.findall(_LITERAL.sub("", r))) if "{" in r or "}" in r else "" for r in rows]
    out, i = [], 0
    while i < len(rows):
        m = (_JS if language == "javascript" else _DECL).match(rows[i])
        head = rows[i]
        if not m and language != "javascript" and _TYPE.match(head) and i + 1 < len(rows):
            head = f"{head.rstrip()} {rows[i + 1].lstrip()}"
            m = _DECL.match(head)
        if not m or (language != "javascript" and _CONTROL.search(head)):
            i += 1
            continue
        depth, opened, end = 0, False, None
        for j in range(i, len(rows)):
            if braces[j]:
                for c in braces[j]:
                    depth += 1 if c == "{" else -1
                    opened |= depth > 0
            if opened and depth <= 0:
                end = j
                break
        if end is None:
            i += 1
            continue
        name = next(g for g in m.groups() if g)
        signature = head.strip()
        out.append((name, i + 1, end + 1, signature if len(signature) <= 80 else signature[:77] + "...", bool(BOILERPLATE.search(name))))
        i = end + 1
    return out


_SPANS = "array<struct<func_name:string,line_start:long,line_end:long,signature:string,is_boilerplate:boolean>>"


_KEYS = ("func_name", "line_start", "line_end", "signature", "is_boilerplate")


def _function_spans(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(_KEYS, s, strict=True)) for s in spans_of(t or "", lang or "c")] for t, lang in zip(texts, languages, strict=True)])


def spans_column(content: Column, language: Column | None = None) -> Column:
    """The spans of a file as an array."""
    return F.pandas_udf(_function_spans, _SPANS)(content, F.lit("c") if language is None else language)


def function_spans(files: DataFrame, language=None) -> DataFrame:
    """func_span(file_id, func_name, line_start, line_end, line_count, signature, is_boilerplate)."""
    rows = files.select("file_id", F.explode(spans_column(F.col("content"), language)).alias("s")).select("file_id", "s.*")
    return rows.withColumn("line_count", F.col("line_end") - F.col("line_start") + 1)


#: Kinds of statements in order; what a check of a statement's result looks like; declarations of host
#: variables; ways out of a function after an error; islands of C under this many lines join the one before.
KINDS = (
    ("DECLARE", r"^DECLARE\s+\w+\s+CURSOR"), ("OPEN", r"^OPEN\s+\w+"), ("FETCH", r"^FETCH\s+\w+"), ("CLOSE", r"^CLOSE\s+\w+"),
    ("COMMIT", r"^COMMIT"), ("ROLLBACK", r"^ROLLBACK"), ("SAVEPOINT", r"^SAVEPOINT"),
    ("SELECT", r"^SELECT\b"), ("INSERT", r"^INSERT\b"), ("UPDATE", r"^UPDATE\b"), ("DELETE", r"^DELETE\b"), ("MERGE", r"^MERGE\b"),
)
CHECKED = re.compile(r"sqlca\.sqlcode|WHENEVER\s+SQLERROR|WHENEVER\s+NOT\s+FOUND", re.I)
DECLARED = re.compile(r"^\s*(?:static\s+|extern\s+|const\s+)*((?:unsigned\s+)?(?:int|char|long|short|float|double|size_t|ssize_t|\w+_t))\s*(\*?)\s+(\w+)\s*(\[[^\]]*\])?\s*(?:=|;|,)")
ERROR_PATH = re.compile(r"\b(return[\s;]|goto\s|break\s*;|exit\s*\(|abort\s*\()", re.I)
MERGED = 5
_INDICATED = re.compile(r":(\w+)\s*(?:INDICATOR\s*)?:(\w+)", re.I)
_EXEC = re.compile(r"[Ee](?<!\w[Ee])[Xx][Ee][Cc][^\S\n]+[Ss][Qq][Ll]\b")
_KIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))
_WHENEVER = re.compile(r"WHENEVER\s+(NOT\s+FOUND|\w+)\s+(.*)", re.I)
_HOST = re.compile(r":(\w+)(?!:)")


def regions_of(text: str, spans: list[tuple] | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """(sql blocks, C segments, host variables declared) of an embedded SQL file, each with the function that its first
    line is in. A block lasts from EXEC SQL to the first line with a semicolon; an unclosed one is C again. WHENEVER
    with CONTINUE clears what is in force. X7: a short island of C joins the segment before if both start in one
    function, with the statements between them."""
    rows = text.split("\n")
    spans = spans_of(text) if spans is None else spans
    starts = [s[1] for s in spans]

    def inside(line: int) -> str | None:
        k = bisect_right(starts, line) - 1
        return spans[k][0] if k >= 0 and line <= spans[k][2] else None

    ends, at = [], 0
    for r in rows:
        at += len(r) + 1
        ends.append(at - 1)
    blocks: list[dict] = []
    code = [False] * len(rows)
    declared: list[dict] = []
    whenever, section, i = None, False, 0
    found = {}
    for m in _EXEC.finditer(text):
        k = bisect_left(ends, m.end())
        found.setdefault(k, m.end() - (ends[k - 1] + 1 if k else 0))
    for at in (*found, len(rows)):
        if at < i:  # within the statement before
            continue
        if section:
            for k in range(i, at):
                if v := DECLARED.match(rows[k]):
                    declared.append({"name": v[3], "c_type": v[1] + v[2] + (v[4] or ""), "line": k + 1, "func_name": inside(k + 1)})
        else:
            code[i:at] = [True] * (at - i)
        if at == len(rows):
            break
        i = j = at
        while j < len(rows) and ";" not in rows[j][found[at] if j == i else 0 :]:
            j += 1
        if j == len(rows):
            code[i:] = [True] * (len(rows) - i)
            break
        raw = "\n".join(rows[i : j + 1])
        body = " ".join(raw[found[at] :].split(";")[0].split())
        upper = body.upper()
        if upper.startswith("BEGIN DECLARE SECTION"):
            section = True
        elif upper.startswith("END DECLARE SECTION"):
            section = False
        elif w := _WHENEVER.match(body):
            whenever = None if w[2].upper().startswith("CONTINUE") else body
        elif not upper.startswith("INCLUDE"):
            kind = m.lastgroup if (m := _KIND.match(upper)) else "OTHER"
            plain, indicators = body, []
            if ":" in body:
                indicators = [x[1] for x in _INDICATED.findall(body)]
                plain = _INDICATED.sub(r":\1", body) if indicators else body
            hosts = list(dict.fromkeys(_HOST.findall(plain)))
            after = text[ends[j] : ends[j] + 200]
            blocks.append({"kind": kind, "sql_text": body, "line_start": i + 1, "line_end": j + 1, "host_vars": hosts, "indicators": indicators, "has_sqlca_check": bool(CHECKED.search(after)), "whenever": whenever, "func_name": inside(i + 1)})
        i = j + 1
    segments: list[dict] = []
    i = 0
    while i < len(rows):
        if not code[i]:
            i += 1
            continue
        j = i
        while j < len(rows) and code[j]:
            j += 1
        name = inside(i + 1)
        if segments and j - i < MERGED and name is not None and segments[-1]["func_name"] == name:
            segments[-1]["line_end"] = j
        else:
            segments.append({"line_start": i + 1, "line_end": j, "func_name": name})
        i = j
    for s in segments:
        s["error_path"] = bool(ERROR_PATH.search("\n".join(rows[s["line_start"] - 1 : s["line_end"]])))
    return blocks, segments, declared


_REGIONS = (
    "struct<blocks:array<struct<kind:string,sql_text:string,line_start:long,line_end:long,host_vars:array<string>,indicators:array<string>,has_sqlca_check:boolean,whenever:string,func_name:string>>,"
    "segments:array<struct<line_start:long,line_end:long,func_name:string,error_path:boolean>>,declared:array<struct<name:string,c_type:string,line:long,func_name:string>>,"
    f"spans:{_SPANS}>"
)


def _regions(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = spans_of(text or "")
        rows.append((*regions_of(text or "", spans), [dict(zip(_KEYS, s, strict=True)) for s in spans]))
    return pd.DataFrame(rows, columns=["blocks", "segments", "declared", "spans"])


def regions(files: DataFrame) -> DataFrame:
    """(file_id, content, r): the parse of each file, spans included, for the relations below to share."""
    return files.withColumn("r", F.pandas_udf(_regions, _REGIONS)("content"))


def parsed_spans(parsed: DataFrame) -> DataFrame:
    """function_spans of what regions() has parsed."""
    rows = parsed.select("file_id", F.inline("r.spans"))
    return rows.withColumn("line_count", F.col("line_end") - F.col("line_start") + 1)


def sql_blocks(parsed: DataFrame) -> DataFrame:
    """sql_block, numbered by `block_no` within its file."""
    rows = parsed.select("file_id", F.posexplode("r.blocks").alias("pos", "b"))
    return rows.select("file_id", (F.col("pos") + 1).cast("long").alias("block_no"), "b.*")


def c_segments(parsed: DataFrame) -> DataFrame:
    """X7."""
    return parsed.select("file_id", F.inline("r.segments"))


def host_variables(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Declared variables, with the indicator declared as <name>_ind, and those that only SQL uses as `unknown`; the
    first of a name wins."""
    columns = ["file_id", "name", "c_type", "line", "func_name"]
    declared = parsed.select("file_id", F.inline("r.declared")).select(*columns, F.lit(0).alias("o"))
    names = declared.select("file_id", F.col("name").alias("indicator")).distinct()
    names = names.withColumn("name", F.regexp_extract("indicator", "^(.*)_ind$", 1)).where("name <> ''")
    declared = declared.join(names, ["file_id", "name"], "left").select(*columns, "o", "indicator")
    used = blocks.select("file_id", F.explode(F.concat("host_vars", "indicators")).alias("name"), F.lit("unknown").alias("c_type"), F.col("line_start").alias("line"), "func_name", F.lit(1).alias("o"), F.lit(None).cast("string").alias("indicator"))
    first = Window.partitionBy("file_id", "name").orderBy("o", "line")
    return declared.union(used).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "o")


def cursor_events(blocks: DataFrame) -> DataFrame:
    """cursor_event(file_id, cursor, event_type, line, func_name) of DECLARE, OPEN, FETCH and CLOSE."""
    cursor = F.regexp_extract("sql_text", r"(?i)^(?:DECLARE|OPEN|FETCH|CLOSE)\s+(\w+)", 1)
    return blocks.where(F.col("kind").isin("DECLARE", "OPEN", "FETCH", "CLOSE")).select("file_id", cursor.alias("cursor"), F.col("kind").alias("event_type"), F.col("line_start").alias("line"), "func_name")


def transaction_points(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("kind").isin("COMMIT", "ROLLBACK", "SAVEPOINT")).select("file_id", "kind", F.col("line_start").alias("line"), "func_name")


def pack_lines(spans: DataFrame, cap: int = 1200) -> DataFrame:
    """(file_id, group_no, func_name): consecutive functions until their lines pass the cap; a sum with a reset."""
    ordered = F.array_sort(F.collect_list(F.struct("line_start", "line_count", "func_name")))
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("no"), F.array().cast("array<struct<no:int,func_name:string>>").alias("out"))

    def step(a, x):
        over = (a["sum"] > 0) & (a["sum"] + x["line_count"] > cap)
        no = F.when(over, a["no"] + 1).otherwise(a["no"])
        return F.struct(F.when(over, x["line_count"]).otherwise(a["sum"] + x["line_count"]).alias("sum"), no.alias("no"), F.concat(a["out"], F.array(F.struct(no.alias("no"), x["func_name"].alias("func_name")))).alias("out"))

    rows = spans.groupBy("file_id").agg(F.aggregate(ordered, begin, step)["out"].alias("g"))
    return rows.select("file_id", F.explode("g").alias("g")).select("file_id", F.col("g.no").cast("long").alias("group_no"), "g.func_name")
