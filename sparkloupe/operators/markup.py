"""Markup: structure of screen definitions, inline scripts, and the automata that JavaScript needs."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_IDS = ("column", "columninfo", "data")
_CALL = re.compile(r"(?:scwin\.)?([A-Za-z_$][\w$]*)\s*\(")
_WORDS = frozenset("if for while switch return function typeof new catch".split())
_PARSED = (
    "struct<error:string,elements:array<struct<tag:string,id:string,line:long>>,events:array<struct<id:string,tag:string,event:string,handler:string,functions:array<string>,line:long>>,"
    "columns:array<struct<list_id:string,column_id:string,name:string,data_type:string,line:long>>>"
)


def parse_markup(text: str) -> tuple:
    """(error, elements, events, columns); a document with DOCTYPE or ENTITY is refused, a malformed one is an error."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        return "refused: DOCTYPE or ENTITY", [], [], []
    elements, events, columns, lists = [], [], [], []
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict) -> None:
        tag, line = name.split(":")[-1], parser.CurrentLineNumber
        ident = attributes.get("id")
        elements.append({"tag": tag, "id": ident, "line": line})
        if tag.lower() == "datalist":
            lists.append(ident)
        if tag.lower() in ("column", "columninfo") and lists:
            columns.append({"list_id": lists[-1], "column_id": ident, "name": attributes.get("name"), "data_type": attributes.get("dataType"), "line": line})
        for key, handler in attributes.items():
            event = key.split(":")[-1]
            if re.fullmatch(r"on\w+", event):
                functions = list(dict.fromkeys(f for f in _CALL.findall(handler) if f not in _WORDS)) or re.findall(r"scwin\.([\w$]+)", handler)
                events.append({"id": ident, "tag": tag, "event": event, "handler": handler, "functions": functions, "line": line})

    def end(name: str) -> None:
        if name.split(":")[-1].lower() == "datalist" and lists:
            lists.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        return f"parse error: {e}", [], [], []
    return None, elements, events, columns


def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_markup(t) if t is not None else ("no content", [], [], []) for t in texts], columns=["error", "elements", "events", "columns"])


def parsed(files: DataFrame) -> DataFrame:
    """files(file_id, content) with `x`, the parse that the relations below share."""
    return files.withColumn("x", F.pandas_udf(_parse, _PARSED)("content"))


def xml_events(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", F.explode("x.events").alias("e")).select("file_id", "e.*")


def xml_columns(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", F.explode("x.columns").alias("c")).select("file_id", "c.*")


def list_errors(rows: DataFrame) -> DataFrame:
    """(file_id, line, message) of lists without an id, or with a blank one or a colon."""
    e = rows.select("file_id", F.explode("x.elements").alias("e")).where(F.lower("e.tag") == "datalist")
    ident = F.coalesce("e.id", F.lit(""))
    message = F.concat(F.lit("L"), F.col("e.line").cast("string"), F.lit(": dataList ID가 비어있거나 유효하지 않음: '"), ident, F.lit("'"))
    return e.where(F.trim(ident).isin("", ":")).select("file_id", F.col("e.line").alias("line"), message.alias("message"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ids on several elements of a file, columns and data aside: (file_id, id, n, lines)."""
    e = rows.select("file_id", F.explode("x.elements").alias("e")).where(F.col("e.id").isNotNull() & ~F.lower("e.tag").isin(*NO_IDS))
    return e.groupBy("file_id", F.col("e.id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("e.line")), lambda x: x.cast("string")), ",").alias("lines")).where("n > 1")


def handlers_without_script(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that handlers call and no script of the file's stem has: an anti join. calls(file_id, name)."""
    return events.select("file_id", F.explode("functions").alias("name"), "line").join(calls.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")


def inline_scripts(files: DataFrame) -> DataFrame:
    """X22, the variant for pages: bodies of scripts without a src, with the line each starts on."""
    p = r"(?is)<script(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script>"
    pieces = F.split("content", p, -1)
    rows = files.where(F.col("content").rlike(p)).select("file_id", pieces.alias("p"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("m"), F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("body"))
    rows = rows.select("file_id", F.posexplode("body").alias("pos", "body"), "p", "m")
    before = F.concat(F.array_join(F.slice("p", F.lit(1), F.col("pos") + 1), ""), F.array_join(F.slice("m", F.lit(1), F.col("pos")), ""), F.regexp_extract(F.element_at("m", F.col("pos") + 1), r"(?is)^(<script[^>]*>)", 1))
    return rows.select("file_id", (F.col("pos") + 1).cast("long").alias("script_no"), (F.regexp_count(before, F.lit("\n")) + 1).cast("long").alias("line_no"), "body")


#: What tells script from other text.
SCRIPT = re.compile(r"(?:function\b|var\b|let\b|const\b|scwin\.|return\b|if\s*\(|\{)")


def cdata_blocks(text: str) -> list[dict]:
    """Script in CDATA sections of <script> elements without a src, if it holds a word of script: the line it starts on,
    its first line in all script joined, its lines and its text. Goes line by line; text before and after the section
    on its own lines counts if it isn't blank."""
    out, cursor, inside, start, held = [], 1, False, None, []

    def add(line: int, body: list[str]) -> None:
        nonlocal cursor
        whole = "\n".join(body)
        if whole.strip() and SCRIPT.search(whole):
            out.append({"xml_start": line, "js_start": cursor, "length": len(body), "body": whole})
            cursor += len(body)

    for number, line in enumerate(text.split("\n"), 1):
        lower = line.lower()
        if "<script" in lower and "src=" not in lower:
            inside, start, held = True, None, []
        if inside and "<![CDATA[" in line:
            after = line.split("<![CDATA[", 1)[1]
            start = number
            if "]]>" in after:
                add(number, [after.split("]]>", 1)[0]])
                start = None
            elif after.strip():
                held.append(after)
        elif inside and start is not None:
            if "]]>" in line:
                before = line.split("]]>", 1)[0]
                add(start + 1, [*held, *([before] if before.strip() else [])])
                start, held = None, []
            else:
                held.append(line)
        if "</script>" in lower:
            inside = False
    return out


def _cdata(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: cdata_blocks(t or ""))


def cdata_scripts(files: DataFrame) -> DataFrame:
    """(file_id, script_no, xml_start, js_start, length, body) of screens' scripts; `first`, `last` and `offset` of
    rebase() are js_start, js_start + length - 1 and xml_start - js_start."""
    schema = "array<struct<xml_start:long,js_start:long,length:long,body:string>>"
    rows = files.select("file_id", F.posexplode(F.pandas_udf(_cdata, schema)("content")).alias("pos", "s"))
    return rows.select("file_id", (F.col("pos") + 1).cast("long").alias("script_no"), "s.*")


def rebase(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """lines(file_id, line_no) of concatenated scripts to lines of their file, by blocks(file_id, first, last,
    offset); lines outside every block pass through."""
    b = blocks.select(F.col("file_id").alias("_f"), "first", "last", "offset")
    rows = lines.join(b, (lines.file_id == F.col("_f")) & lines.line_no.between(F.col("first"), F.col("last")), "left")
    return rows.withColumn("file_line", F.col("line_no") + F.coalesce("offset", F.lit(0))).drop("_f", "first", "last", "offset")


def loops_of(text: str) -> list[dict]:
    """J-S1, J-S2: an inner for over an open loop's variable, and a deferred call within a var loop that uses its
    variable within five lines; only the outermost open loop is tested for the latter."""
    out, stack, depth = [], [], 0
    rows = [re.sub(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|//.*$|/\*.*?\*/)""", "", r) for r in text.split("\n")]
    for i, row in enumerate(rows):
        m = re.search(r"\bfor\s*\(\s*(var\s+|let\s+|const\s+)?([A-Za-z_$][\w$]*)\s*=", row)
        if m:
            if (m[1] or "var ").strip() == "var" and any(v == m[2] for v, _, _ in stack):
                out.append({"rule": "NESTED_VAR_LOOP", "severity": "critical", "line": i + 1, "variable": m[2]})
            stack.append((m[2], depth, (m[1] or "").strip() == "var"))
        elif stack and stack[0][2] and re.search(r"\b(setTimeout|setInterval|addEventListener)\s*\(|\.(then|forEach)\s*\(", row):
            near = " ".join(rows[i : i + 5])
            if re.search(rf"\b{re.escape(stack[0][0])}\b", near) and re.search(r"\bfunction\b|=>", near):
                out.append({"rule": "VAR_CLOSURE_LOOP", "severity": "high", "line": i + 1, "variable": stack[0][0]})
        opened = row.count("{")
        depth += opened - row.count("}")
        while stack and depth <= stack[-1][1] and (not m or not opened or depth < stack[-1][1] or row.count("}")) and not (m and stack[-1][0] == m[2] and not row.count("}")):
            stack.pop()
    return out


def _loops(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: loops_of(t or ""))


def loop_rules(files: DataFrame) -> DataFrame:
    schema = "array<struct<rule:string,severity:string,line:long,variable:string>>"
    return files.select("file_id", F.explode(F.pandas_udf(_loops, schema)("content")).alias("f")).select("file_id", "f.*")


def chunks_of(lines: list[str], ends: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """Texts over `most` lines are cut at the first function end in [least, most) lines, else at a blank line
    there, else after `least`."""
    out, start = [], 1
    while len(lines) - start + 1 > most:
        cut = next((e for e in ends if start + least <= e + 1 <= start + most - 1), None) or next((i for i in range(start + least, start + most) if not lines[i - 1].strip()), start + least - 1)
        out.append((start, cut))
        start = cut + 1
    return [*out, (start, len(lines))]


def chunks(files: DataFrame, least: int = 2000, most: int = 2400) -> DataFrame:
    """(file_id, chunk_no, line_start, line_end) of JavaScript files."""
    from .structure import spans_of

    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows = (t or "").split("\n")
            out.append([{"line_start": a, "line_end": b} for a, b in chunks_of(rows, [s[2] for s in spans_of(t or "", "javascript")], least, most)])
        return pd.Series(out)

    rows = files.select("file_id", F.posexplode(F.pandas_udf(cut, "array<struct<line_start:long,line_end:long>>")("content")).alias("pos", "c"))
    return rows.select("file_id", (F.col("pos") + 1).cast("long").alias("chunk_no"), "c.*")


FORMATTED = {"printf": 0, "fprintf": 1, "sprintf": 1, "syslog": 1, "snprintf": 2}


def format_calls_of(text: str) -> list[dict]:
    """Printf-family calls with a literal format: (line, function, conversions, arguments). `%%` is no conversion;
    a `*` width counts no argument; adjacent literals are one; other formats are passed over."""
    out = []
    for m in re.finditer(r"\b(printf|fprintf|sprintf|snprintf|syslog)\s*\(", text):
        depth, parts, at, i = 1, [], m.end(), m.end()
        while i < len(text) and depth:
            if text[i] in "\"'":
                quote, i = text[i], i + 1
                while i < len(text) and text[i] != quote:
                    i += 2 if text[i] == "\\" else 1
            elif text[i] in "([{":
                depth += 1
            elif text[i] in ")]}":
                depth -= 1
            elif text[i] == "," and depth == 1:
                parts.append(text[at:i])
                at = i + 1
            i += 1
        if depth:
            continue
        parts.append(text[at : i - 1])
        k = FORMATTED[m[1]]
        if len(parts) <= k or not re.fullmatch(r'\s*("(?:[^"\\]|\\.)*"\s*)+', parts[k]):
            continue
        fmt = "".join(re.findall(r'"((?:[^"\\]|\\.)*)"', parts[k])).replace("%%", "")
        conversions = len(re.findall(r"%[-+ #0]*(?:\*|\d+)?(?:\.(?:\*|\d+))?(?:hh|h|ll|l|L|z|j|t)?[diouxXeEfFgGaAcspn]", fmt))
        arguments = sum(bool(p.strip()) for p in parts[k + 1 :])
        out.append({"line": text.count("\n", 0, m.start()) + 1, "function": m[1], "conversions": conversions, "arguments": arguments})
    return out


def format_mismatches(files: DataFrame) -> DataFrame:
    """Calls whose conversions and arguments differ in number; comments are blanked first."""
    from ..functions import text as T

    udf = F.pandas_udf(lambda s: s.map(lambda t: format_calls_of(t or "")), "array<struct<line:long,function:string,conversions:long,arguments:long>>")
    return files.select("file_id", F.explode(udf(T.blank_comments(F.col("content")))).alias("c")).select("file_id", "c.*").where("conversions <> arguments")


def uninitialised(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Indented declarations without a value in a function whose variable's first later mention there is neither an
    assignment, a for's start, an address nor an INIT2 macro; variables that are never mentioned are safe."""
    from .search import enclosing

    p = r"^\s+(?:unsigned\s+)?(?:int|char|long|short|double|float|\w+_t)\s+(\w+)\s*;"
    inside = enclosing(lines.select("file_id", "line_no", "raw"), spans).where("func_name is not null")
    declared = inside.where(F.col("raw").rlike(p)).select("file_id", "func_name", F.col("line_no").alias("declared"), F.regexp_extract("raw", p, 1).alias("variable"))
    words = inside.select("file_id", "func_name", "line_no", "raw", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("variable"))
    later = declared.join(words, ["file_id", "func_name", "variable"]).where("line_no > declared")
    first = later.groupBy("file_id", "func_name", "variable", "declared").agg(F.min_by("raw", "line_no").alias("raw"))
    safe = F.expr("regexp_like(raw, concat('(\\\\b', variable, '\\\\s*=[^=]|\\\\bfor\\\\s*\\\\(\\\\s*', variable, '\\\\b|&\\\\s*', variable, '\\\\b|INIT2(VCHAR|STR)\\\\s*\\\\(\\\\s*', variable, '\\\\b)'))")
    return first.where(~safe).select("file_id", "func_name", "variable", F.col("declared").alias("line_no"))


def script_order(rows: DataFrame) -> DataFrame:
    """Scripts of a file as one text, with the block table that `rebase` needs."""
    n = F.regexp_count("body", F.lit("\n")) + 1
    w = Window.partitionBy("file_id").orderBy("script_no")
    last = F.sum(n).over(w)
    return rows.select("file_id", "script_no", (last - n + 1).cast("long").alias("first"), last.cast("long").alias("last"), (F.col("line_no") - (last - n + 1)).cast("long").alias("offset"))
