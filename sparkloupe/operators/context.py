"""Context of files: cleaned corpora, global declarations, summaries, snippets, merged contexts, references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EVENTS
from ..functions import text as T
from .search import enclosing

#: How a reference without an extension may be completed.
SUFFIXES = ("", ".js", ".c", ".h", ".pc", ".sql")


def strip_corpus(files: DataFrame) -> DataFrame:
    """files(file_id, language, content) with code (comments out, hyphens between digits in literals as stars, save
    in markup), the characters removed, and whether the line count stayed. Other languages stay as they are."""
    c, language = F.col("content"), F.col("language")
    script = T.strip_js(F.when(language == "javascript", c))
    code = F.when(language == "javascript", T.star_hyphens(script)).when(language == "c", T.star_hyphens(T.strip_c(c))).when(language == "proc", T.star_hyphens(T.strip_proc(c)))
    code = code.when(language == "sql", T.star_hyphens(T.strip_sql(c), sql=True)).when(language == "xml", T.strip_xml(c)).otherwise(c)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    rows = files.withColumn("code", code)
    return rows.withColumns({"removed": (F.length("content") - F.length("code")).cast("long"), "lines_kept": breaks(F.col("content")) == breaks(F.col("code"))}).drop("content")


def optimise(content: Column, summary: Column, most: int = 500, head: int = 200, tail: int = 100) -> Column:
    """Texts over `most` lines: the first and last lines around a summary."""
    parts = T.lines(content)
    n = F.size(parts)
    cut = F.concat(F.slice(parts, 1, head), F.array(summary), F.slice(parts, n - tail + 1, F.lit(tail)))
    return F.when(n > most, F.array_join(cut, "\n")).otherwise(content)


def cursor_bodies(blocks: DataFrame, lines: DataFrame, reach: int = 200) -> DataFrame:
    """(file_id, cursor, body): the SELECT of a cursor's declaration; or, where that names a prepared statement,
    the literal it is prepared from, or all literals from the last line before the PREPARE, `reach` at most, that fills
    its buffer (with or without a cast and a member) up to the PREPARE, if they hold a SELECT; else null.

    As-of by one window over fills and PREPAREs; the lines between come by an equi join by file with a range of at
    most `reach` lines."""
    declared = blocks.where("kind = 'DECLARE'").select("file_id", F.regexp_extract("sql_text", r"(?i)^DECLARE\s+(\w+)", 1).alias("cursor"), F.regexp_extract("sql_text", r"(?is)\bFOR\s+(SELECT\s.*)$", 1).alias("direct"), F.lower(F.regexp_extract("sql_text", r"(?i)\bFOR\s+(?!SELECT\b)(\w+)\s*$", 1)).alias("statement"))
    prepares = blocks.where(F.col("sql_text").rlike(r"(?i)^PREPARE\s")).select("file_id", F.lower(F.regexp_extract("sql_text", r"(?i)^PREPARE\s+(\w+)", 1)).alias("statement"), F.regexp_extract("sql_text", r"(?i)\bFROM\s+:(\w+)", 1).alias("buffer"), F.regexp_extract("sql_text", r'(?i)\bFROM\s+"([^"]+)"', 1).alias("literal"), F.col("line_start").alias("at"))
    last = Window.partitionBy("file_id", "statement").orderBy(F.desc("at"))
    prepares = prepares.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    p = r"\b(?:s?n?printf|strcpy|strcat)\s*\(\s*(?:\([^)]*\))?\s*(\w+)(?:\.arr)?\s*,"
    fills = lines.where(F.col("raw").rlike(p)).select("file_id", F.regexp_extract("raw", p, 1).alias("buffer"), F.col("line_no").alias("at"), F.lit(None).cast("string").alias("statement"))
    w = Window.partitionBy("file_id", "buffer").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.last(F.when(F.col("statement").isNull(), F.col("at")), ignorenulls=True).over(w)
    bound = fills.union(prepares.where("buffer <> ''").select("file_id", "buffer", "at", "statement")).withColumn("filled", filled).where((F.col("statement").isNotNull()) & (F.col("at") - F.col("filled") <= reach))
    near = bound.select("file_id", "statement", "at", F.explode(F.sequence("filled", F.col("at") - 1)).alias("line_no")).join(lines.select("file_id", "line_no", "raw"), ["file_id", "line_no"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    pieces = F.transform(F.regexp_extract_all(text, F.lit(r'(?s)"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda s: F.regexp_replace(s, r"(?s)\\(.)", "$1"))
    traced = near.groupBy("file_id", "statement").agg(F.trim(F.array_join(pieces, "")).alias("traced")).where(F.col("traced").rlike(r"(?i)\bSELECT\b"))
    rows = declared.join(prepares.select("file_id", "statement", "literal"), ["file_id", "statement"], "left").join(traced, ["file_id", "statement"], "left")
    return rows.select("file_id", "cursor", F.coalesce(F.nullif("direct", F.lit("")), F.nullif(F.trim("literal"), F.lit("")), "traced").alias("body"))


def global_context(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, text) of includes, macros, types and variables outside every function."""
    kind = F.when(F.col("raw").rlike(r"^\s*#\s*include\b"), "include").when(F.col("raw").rlike(r"^\s*#\s*define\b"), "macro").when(F.col("raw").rlike(r"^\s*typedef\b"), "typedef").when(F.col("raw").rlike(r"^\s*(struct|union|enum)\s+\w+\s*\{"), "struct").when(F.col("raw").rlike(r"^\s*(static\s+|extern\s+)?(\w+\s+)+\**\w+(\[[^\]]*\])*\s*(=[^;]*)?;"), "global")
    rows = enclosing(lines, spans).where("func_name is null").withColumn("kind", kind).where("kind is not null")
    return rows.select("file_id", "line_no", "kind", F.trim("raw").alias("text"))


def exec_sql_statements(files: DataFrame) -> DataFrame:
    """Every EXEC SQL statement up to its semicolon, over lines, with the line it starts on; declarations and
    directives don't count."""
    p = r"(?is)\bEXEC\s+SQL\s+([^;]*);"
    rows = files.where(F.col("content").rlike(p)).select("file_id", F.split("content", p, -1).alias("gap"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("m"), F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("body"))
    rows = rows.select("file_id", "gap", "m", F.posexplode("body").alias("pos", "sql_text"))
    breaks = F.regexp_count(F.concat(F.array_join(F.slice("gap", F.lit(1), F.col("pos") + 1), ""), F.array_join(F.slice("m", F.lit(1), F.col("pos")), "")), F.lit("\n"))
    return rows.where(~F.col("sql_text").rlike(r"(?i)^(BEGIN|END|INCLUDE|WHENEVER|VAR|TYPE|DECLARE)\b")).select("file_id", (breaks + 1).cast("long").alias("line_no"), "sql_text")


def function_summary(spans: DataFrame) -> DataFrame:
    """A line for each function, in order."""
    line = F.concat(F.lit("[L"), F.col("line_start").cast("string"), F.lit("~L"), F.col("line_end").cast("string"), F.lit("] "), "signature", F.lit(" - "), F.col("line_count").cast("string"), F.lit(" lines"))
    return spans.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", line.alias("t")))), lambda x: x["t"]), "\n").alias("summary"))


def structure_summary(imports: DataFrame, calls: DataFrame, spans: DataFrame, variables: DataFrame | None = None, most: int = 20) -> DataFrame:
    """Counts and the first names of imports, calls and functions of each file, the first 30 signatures in order,
    and, where global_context() is given, the first variables of it."""
    first = lambda rows, column, name: rows.groupBy("file_id").agg(F.countDistinct(column).alias(f"n_{name}"), F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, most), ", ").alias(name))
    out = first(spans, "func_name", "functions").join(first(calls, "name", "calls"), "file_id", "full_outer").join(first(imports, "target", "imports"), "file_id", "full_outer")
    lines = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line_start", "signature"))), 1, 30), lambda x: x["signature"])
    out = out.join(spans.groupBy("file_id").agg(F.array_join(lines, "\n").alias("signatures")), "file_id", "left")
    extra = ["signatures"]
    if variables is not None:
        named = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "text"))), 1, most), lambda x: x["text"])
        out = out.join(variables.where("kind = 'global'").groupBy("file_id").agg(F.array_join(named, ", ").alias("globals")), "file_id", "left")
        extra.append("globals")
    return out.select("file_id", *[F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in ("functions", "calls", "imports")], *[F.coalesce(n, F.lit("")).alias(n) for n in ("functions", "calls", "imports", *extra)])


def around_errors(errors: DataFrame, spans: DataFrame, reach: int = 20) -> DataFrame:
    """The ranges to show for errors(file_id, line_no): the enclosing function, else the lines around; once each."""
    s = spans.select(F.col("file_id").alias("_f"), "line_start", "line_end")
    rows = errors.join(s, (errors.file_id == F.col("_f")) & errors.line_no.between(F.col("line_start"), F.col("line_end")), "left")
    low, high = F.coalesce("line_start", F.greatest(F.col("line_no") - reach, F.lit(1))), F.coalesce("line_end", F.col("line_no") + reach)
    return rows.select("file_id", low.cast("long").alias("line_start"), high.cast("long").alias("line_end")).distinct()


def statement_spans(lines: DataFrame) -> DataFrame:
    """Gaps and islands of SQL statements: from a line that starts one to a line that ends with a semicolon."""
    starts = F.col("raw").rlike(r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE|ALTER|DROP|WITH|TRUNCATE)\b")
    ends = F.col("raw").rlike(r";\s*$")
    w = Window.partitionBy("file_id").orderBy("line_no")
    part = F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumns({"part": part, "starts": starts}).groupBy("file_id", "part").agg(F.min(F.when(F.col("starts"), F.col("line_no"))).alias("line_start"), F.max("line_no").alias("line_end"))
    return rows.where("line_start is not null").select("file_id", "line_start", "line_end")


def function_classes(spans: DataFrame) -> DataFrame:
    """Boilerplate, utility (numbered names of the letters z and s, and names after rep_) or dispatch, by name; a
    utility alone in its group of a file is dispatch."""
    name = F.lower("func_name")
    fixed = name.rlike(r"^main$|_init_proc$|_exit_proc$|^z\w{3}b\w+\d+$")
    group = F.when(fixed, F.lit(None)).when(name.rlike(r"^[zs]\d{2,3}_"), F.left(name, F.lit(1))).when(name.startswith("rep_") & ~name.rlike(r"^[a-z]\d{2,3}_"), "rep")
    rows = spans.select("file_id", "func_name", "line_start", fixed.alias("fixed"), group.alias("group"))
    many = rows.where("group is not null").groupBy("file_id", "group").agg(F.count("*").alias("many"))
    kind = F.when(F.col("fixed"), "boilerplate").when(F.col("many") >= 2, "utility").otherwise("dispatch")
    return rows.join(many, ["file_id", "group"], "left").select("file_id", "func_name", "line_start", kind.alias("function_class"))


def list_summary(columns: DataFrame) -> DataFrame:
    """`id: n columns` for each list of a screen."""
    n = columns.groupBy("file_id", "list_id").agg(F.count("*").alias("n"))
    return n.select("file_id", "list_id", F.concat("list_id", F.lit(": "), F.col("n").cast("string"), F.lit(" columns")).alias("summary"))


def struct_formats(lines: DataFrame) -> DataFrame:
    """Printf with %s and an argument that ends in an indexed struct, without a member of the element."""
    c = F.col("raw")
    return lines.where(c.rlike(r"\b(printf|PFM_\w+)\s*\(.*%s") & c.rlike(r"\w+\.\w+(\.\w+)*\[[^\]]*\]\s*[,)]") & ~c.rlike(r"\]\s*\.\s*\w")).select("file_id", "line_no", F.lit("FORMAT_STRUCT").alias("rule_id"), F.lit("critical").alias("severity"))


def memset_declared(lines: DataFrame) -> DataFrame:
    """R2: memset(&v, .., sizeof(T)): v's declared type in the file if it is known, else the names' cores, differ from T;
    sizeof(v) is exempt. A left equi join of facts with declarations."""
    p = r"\bmemset\s*\(\s*&\s*(\w+)\s*,[^,]*,\s*sizeof\s*\(\s*(\w+)\s*\)"
    facts = lines.where(F.col("raw").rlike(p)).select("file_id", "line_no", F.regexp_extract("raw", p, 1).alias("variable"), F.regexp_extract("raw", p, 2).alias("size_type"))
    d = r"^\s*(?:static\s+|struct\s+)?(\w+)\s+(\w+)\s*(?:=[^;]*)?;"
    declared = lines.where(F.col("raw").rlike(d) & ~F.col("raw").rlike(r"^\s*(return|goto)\b")).groupBy("file_id", F.regexp_extract("raw", d, 2).alias("variable")).agg(F.min_by(F.regexp_extract("raw", d, 1), "line_no").alias("declared_type"))
    core = lambda c: F.regexp_replace(F.regexp_replace(c, "^[lcds]_", ""), "_t$", "")
    a, b = core(F.col("variable")), core(F.col("size_type"))
    wrong = F.when(F.col("declared_type").isNotNull(), F.col("declared_type") != F.col("size_type")).otherwise(~(F.contains(a, b) | F.contains(b, a)))
    return facts.where("variable <> size_type").join(declared, ["file_id", "variable"], "left").where(wrong).select("file_id", "line_no", "variable", "size_type", "declared_type")


def loops_without_init(text: str, most: int = 500) -> list[dict]:
    """Loops of up to `most` lines in whose body a struct is written and not initialised; inner loops aren't scanned
    again."""
    rows, out, i = text.split("\n"), [], 0
    bare = [re.sub(r'"(?:[^"\\]|\\.)*"|//.*$', "", r) for r in rows]
    while i < len(rows):
        if not re.search(r"\b(while|for)\s*\(", bare[i]):
            i += 1
            continue
        depth, opened, end = 0, False, None
        for j in range(i, min(len(rows), i + most)):
            depth += bare[j].count("{") - bare[j].count("}")
            opened |= depth > 0
            if opened and depth <= 0:
                end = j
                break
        if end is None:
            i += 1
            continue
        body = "\n".join(bare[i : end + 1])
        written = set(re.findall(r"\b(?:strncpy|snprintf|memcpy|strcpy)\s*\(\s*(\w+)\s*\.", body))
        ready = set(re.findall(r"\b(?:INIT2\w*|memset)\s*\(\s*&?\s*(\w+)", body)) | set(re.findall(r"\bmemcpy\s*\(\s*&?\s*(\w+)\s*,", body))
        out += [{"line": i + 1, "variable": v} for v in sorted(written - ready)]
        i = end + 1
    return out


def _loops(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: loops_without_init(t or ""))


def loop_init_missing(files: DataFrame) -> DataFrame:
    udf = F.pandas_udf(_loops, "array<struct<line:long,variable:string>>")
    return files.select("file_id", F.explode(udf("content")).alias("f")).select("file_id", F.col("f.line").alias("line_no"), "f.variable")


def merge_contexts(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """calls(file_id, name, line_no, target) of the tool and of a review: once for each (name, line), the tool's
    target first."""
    rows = found.withColumn("_o", F.lit(0)).unionByName(reviewed.withColumn("_o", F.lit(1)))
    return rows.groupBy("file_id", "name", "line_no").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("_o"))).alias("target"))


def override_priorities(tasks: DataFrame, overrides: DataFrame) -> DataFrame:
    """tasks(path, priority) with the priorities that overrides(path, priority) has, ranked anew within a group."""
    o = overrides.select("path", F.col("priority").alias("_p"))
    rows = tasks.join(o, "path", "left").withColumn("priority", F.coalesce("_p", "priority")).drop("_p")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("group_id").orderBy("priority", "path")).cast("long"))


def resolve_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """references(file_id, path, target) to files(path): the path next to the file with any suffix, else an
    equal name, else an equal stem, the first by path; references to the file itself are dropped."""
    base = F.regexp_replace("path", "[^/]*$", "")
    exact = references.select("file_id", "path", "target", F.explode(F.array(*[F.concat(base, F.regexp_replace("target", r"^\./", ""), F.lit(s)) for s in SUFFIXES])).alias("full"))
    a = exact.join(files.select(F.col("path").alias("full")), "full").groupBy("file_id", "path", "target").agg(F.min("full").alias("exact"))
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    stem = lambda c: F.regexp_replace(name(c), r"\.[^.]*$", "")
    by_name = files.groupBy(name("path").alias("_n")).agg(F.min("path").alias("named"))
    by_stem = files.groupBy(stem("path").alias("_s")).agg(F.min("path").alias("stemmed"))
    rows = references.join(a, ["file_id", "path", "target"], "left").withColumns({"_n": name("target"), "_s": stem("target")}).join(by_name, "_n", "left").join(by_stem, "_s", "left")
    return rows.withColumn("resolved", F.coalesce("exact", "named", "stemmed")).where("resolved is not null and resolved <> path").select("file_id", "path", "target", "resolved")


def snippets(findings: DataFrame, lines: DataFrame, reach: int = 5) -> DataFrame:
    """(file_id, line_no, snippet): the lines around each finding's line, itself marked; once for each line."""
    at = findings.select("file_id", F.col("line_no").alias("at")).distinct()
    near = at.select("file_id", "at", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("line_no")).join(lines, ["file_id", "line_no"])
    line = F.concat(F.when(F.col("line_no") == F.col("at"), ">").otherwise(" "), F.col("line_no").cast("string"), F.lit(": "), "raw")
    return near.groupBy("file_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))), lambda x: x["t"]), "\n").alias("snippet")).withColumnRenamed("at", "line_no")


def related_variables(blocks: DataFrame, functions: DataFrame, most: int = 20) -> DataFrame:
    """Host variables of the blocks in functions(file_id, func_name), the first `most` by name: a semi join."""
    used = blocks.join(functions.select("file_id", "func_name").distinct(), ["file_id", "func_name"], "left_semi").select("file_id", F.explode("host_vars").alias("name"))
    return used.groupBy("file_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, most), ",").alias("variables"))


def related_cursors(events: DataFrame, bodies: DataFrame, functions: DataFrame, most: int = 4000) -> DataFrame:
    """(file_id, cursor, events, missing, body) of the cursors with an event in functions(file_id, func_name): all
    their events in order, those they lack, and their SELECT cut at `most` characters."""
    own = events.join(functions.select("file_id", "func_name").distinct(), ["file_id", "func_name"], "left_semi").select("file_id", "cursor").distinct()
    event = F.concat("event_type", F.lit("(L"), F.col("line").cast("string"), F.lit(", "), F.coalesce("func_name", F.lit("?")), F.lit(")"))
    rows = events.join(own, ["file_id", "cursor"], "left_semi").groupBy("file_id", "cursor").agg(F.array_sort(F.collect_list(F.struct("line", event.alias("t"), "event_type"))).alias("e"))
    missing = F.array_except(F.array(*[F.lit(e) for e in EVENTS]), F.transform("e", lambda x: x["event_type"]))
    one = bodies.groupBy("file_id", "cursor").agg(F.min(F.left("body", F.lit(most))).alias("body"))
    return rows.join(one, ["file_id", "cursor"], "left").select("file_id", "cursor", F.array_join(F.transform("e", lambda x: x["t"]), " → ").alias("events"), F.array_join(missing, ",").alias("missing"), "body")


def routes(lint: DataFrame, files: DataFrame) -> DataFrame:
    """Files with a syntax error or a pattern hit, lint(file_id), are reviewed by error; others as a whole."""
    hit = lint.select("file_id").distinct().withColumn("_hit", F.lit(True))
    return files.select("file_id").join(hit, "file_id", "left").select("file_id", F.when(F.col("_hit"), "error_focused").otherwise("whole").alias("route"))


def rule_counts(findings: DataFrame) -> DataFrame:
    """A7."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


def group_stats(spans: DataFrame) -> DataFrame:
    """Functions and their mean, least and greatest length by file."""
    return spans.groupBy("file_id").agg(F.count("*").alias("functions"), F.avg("line_count").alias("mean_lines"), F.min("line_count").alias("least"), F.max("line_count").alias("greatest"))


def resolved_path(path: Column, root: str) -> Column:
    """An absolute path without `.` and `..`; relative ones are under the root."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    step = lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/"))


def with_contexts(files: DataFrame, contexts: DataFrame, root: str) -> DataFrame:
    """files(path) with what contexts(path, seq, ...) say of them, by the path as written or resolved; the last of
    several; nulls for none."""
    said = [c for c in contexts.columns if c not in ("path", "seq")]
    full = resolved_path(F.col("path"), root)
    keyed = contexts.select(F.explode(F.array_distinct(F.array(full, "path"))).alias("path"), "seq", F.struct(*said).alias("said"))
    last = keyed.groupBy("path").agg(F.max_by("said", "seq").alias("said"))
    return files.join(last, "path", "left").select(*files.columns, "said.*")
