"""Rules on embedded SQL blocks, cross checks between C and SQL, and the symbol graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DML, EVENTS

#: SQL types that suit a base C type, and what a conversion function takes its argument for.
TYPE_COMPAT = {
    "int": ("NUMBER", "INTEGER", "INT", "SMALLINT", "NUMERIC"),
    "long": ("NUMBER", "INTEGER", "BIGINT", "NUMERIC"),
    "short": ("NUMBER", "SMALLINT", "INTEGER"),
    "float": ("NUMBER", "FLOAT", "REAL", "NUMERIC"),
    "double": ("NUMBER", "FLOAT", "DOUBLE", "NUMERIC"),
    "char": ("VARCHAR", "VARCHAR2", "CHAR", "NCHAR", "NVARCHAR2", "CLOB", "TEXT"),
}
CONVERSIONS = (("TO_NUMBER", "NUMBER"), ("TO_CHAR", "VARCHAR"))


def _finding(rule: str, severity: str, category: str, line: Column) -> list[Column]:
    return ["file_id", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), line.cast("long").alias("line_no")]


def top_level_count(text: Column) -> Column:
    """Comma-separated parts outside parentheses; inner parentheses are removed from the inside out, five deep."""
    for _ in range(5):
        text = F.regexp_replace(text, r"\([^()]*\)", "")
    return F.size(F.split(text, ","))


def sqlca_missing(blocks: DataFrame) -> DataFrame:
    """DML without a check after it and without a WHENEVER in force."""
    return blocks.where(F.col("kind").isin(*DML) & ~F.col("has_sqlca_check") & F.col("whenever").isNull()).select(*_finding("SQL_SQLCA_MISSING", "high", "data_integrity", F.col("line_start")))


def select_into_mismatch(blocks: DataFrame) -> DataFrame:
    """Select list and INTO list differ in size; every :name counts, indicators, too. `*` is skipped."""
    p = r"(?is)^SELECT\s+(.*?)\s+INTO\s+(.*?)\s+FROM\b"
    columns, into = F.regexp_extract("sql_text", p, 1), F.regexp_extract("sql_text", p, 2)
    return blocks.where((F.col("kind") == "SELECT") & F.col("sql_text").rlike(p) & ~columns.contains("*")).where(top_level_count(columns) != F.regexp_count(into, F.lit(r":\w+"))).select(*_finding("SQL_SELECT_INTO_MISMATCH", "high", "data_integrity", F.col("line_start")))


def host_var_count(blocks: DataFrame) -> DataFrame:
    """INSERT column and value lists differ in size; a parenthesis in a list ends it."""
    p = r"(?is)^INSERT\s+INTO\s+\w+\s*\(([^)]*)\)\s*VALUES\s*\(([^)]*)\)"
    n = lambda i: F.size(F.filter(F.split(F.regexp_extract("sql_text", p, i), ","), lambda x: F.trim(x) != ""))
    return blocks.where((F.col("kind") == "INSERT") & F.col("sql_text").rlike(p)).where(n(1) != n(2)).select(*_finding("SQL_HOST_VAR_COUNT", "high", "data_integrity", F.col("line_start")))


def indicator_missing(blocks: DataFrame) -> DataFrame:
    """SELECT or FETCH into variables without indicators and NVL; a FETCH is exempt if its cursor's SELECT guards
    as many columns as are fetched. An equi join by cursor."""
    guards = F.regexp_count("sql_text", F.lit(r"(?i)\b(?:NVL|COALESCE)\s*\(|\bDECODE\s*\([^()]*NULL"))
    body = blocks.where("kind = 'DECLARE'").groupBy("file_id", F.regexp_extract("sql_text", r"(?i)^DECLARE\s+(\w+)", 1).alias("cursor")).agg(F.max(guards).alias("guards"))
    rows = blocks.where(F.col("kind").isin("SELECT", "FETCH") & (F.size("host_vars") > 0) & (F.size("indicators") == 0) & ~F.col("sql_text").rlike(r"(?i)\bNVL\s*\("))
    rows = rows.withColumn("cursor", F.when(F.col("kind") == "FETCH", F.regexp_extract("sql_text", r"(?i)^FETCH\s+(\w+)", 1)))
    out = rows.join(body, ["file_id", "cursor"], "left").where(F.coalesce("guards", F.lit(0)) < F.size("host_vars"))
    return out.select(*_finding("SQL_INDICATOR_MISSING", "medium", "null_safety", F.col("line_start")))


def cursor_lifecycle(events: DataFrame) -> DataFrame:
    """(file_id, cursor, present, missing, first_line): the events there and those missing, each comma-joined."""
    present = F.array_sort(F.collect_set("event_type"))
    rows = events.groupBy("file_id", "cursor").agg(present.alias("p"), F.min("line").alias("first_line"))
    missing = F.array_except(F.array(*[F.lit(e) for e in EVENTS]), F.col("p"))
    return rows.select("file_id", "cursor", F.array_join("p", ",").alias("present"), F.array_join(missing, ",").alias("missing"), F.col("first_line").cast("long").alias("first_line"))


def cursor_rules(lifecycle: DataFrame) -> DataFrame:
    """A row for each rule that a cursor breaks."""
    has = lambda e: F.array_contains(F.split("present", ","), e)
    rules = (
        ("SQL_CURSOR_OPEN_MISSING", "high", has("DECLARE") & ~has("OPEN")),
        ("SQL_CURSOR_CLOSE_MISSING", "high", has("OPEN") & ~has("CLOSE")),
        ("SQL_CURSOR_FETCH_MISSING", "medium", has("OPEN") & ~has("FETCH")),
        ("CROSS_CURSOR_INCOMPLETE", "high", F.col("missing") != ""),
    )
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, c in rules]), lambda x: x.isNotNull())
    return lifecycle.select("file_id", "cursor", F.explode(hits).alias("h"), "first_line").select("file_id", "cursor", "h.rule_id", "h.severity", F.col("first_line").alias("line_no"))


def file_rules(blocks: DataFrame) -> DataFrame:
    """Files with DML and no transaction point, at their first DML; files that commit and never roll back."""
    dml = F.col("kind").isin(*DML)
    per = blocks.groupBy("file_id").agg(F.min(F.when(dml, F.col("line_start"))).alias("dml"), F.min(F.when(F.col("kind") == "COMMIT", F.col("line_start"))).alias("commit"), F.max(F.col("kind").isin("COMMIT", "ROLLBACK", "SAVEPOINT")).alias("tx"), F.max(F.col("kind") == "ROLLBACK").alias("rollback"))
    e8 = per.where("dml is not null and not tx").select(*_finding("SQL_COMMIT_MISSING", "medium", "data_integrity", F.col("dml")))
    return e8.union(per.where("commit is not null and not rollback").select(*_finding("CROSS_TRANSACTION_MISSING_ROLLBACK", "high", "data_integrity", F.col("commit"))))


def undeclared_host_vars(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """K1: variables that SQL uses and no declare section has: an anti join. declared(file_id, name)."""
    used = blocks.select("file_id", F.explode("host_vars").alias("name"), "line_start").groupBy("file_id", "name").agg(F.min("line_start").alias("line_no"))
    return used.join(declared.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")


def type_mismatches(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """K2: a host variable of a SELECT, INSERT or UPDATE is an argument of a conversion function that its declared type
    doesn't suit. Types that the table doesn't have, and unknown ones, suit everything. declared(file_id, name, c_type)."""
    used = blocks.where(F.col("kind").isin("SELECT", "INSERT", "UPDATE")).select("file_id", "line_start", "sql_text", F.explode("host_vars").alias("name"))
    context = F.lit(None).cast("string")
    for function, kind in reversed(CONVERSIONS):
        context = F.when(F.expr(f"regexp_like(sql_text, concat('(?i){function}\\\\s*\\\\([^)]*:', name))"), F.lit(kind)).otherwise(context)
    base = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.trim("c_type")), r"\s*[\[*].*", "")), r"^(unsigned|signed)\s+", ""))
    known, suits = base.isin(*TYPE_COMPAT), F.lit(False)
    for c_type, kinds in TYPE_COMPAT.items():
        suits = suits | ((base == c_type) & F.col("context").isin(*kinds))
    rows = used.withColumn("context", context).where("context is not null").join(declared.where("c_type <> 'unknown'"), ["file_id", "name"])
    return rows.where(known & ~suits).select("file_id", "name", "context", "c_type", F.col("line_start").alias("line_no"))


def cursor_function_split(events: DataFrame, calls: DataFrame) -> DataFrame:
    """K3: a function opens a cursor that only other functions close, none of which it calls directly."""
    opened = events.where("event_type = 'OPEN'").groupBy("file_id", "cursor", F.col("func_name").alias("opener")).agg(F.min("line").alias("line_no"))
    closed = events.where("event_type = 'CLOSE'").select("file_id", "cursor", F.col("func_name").alias("closer")).distinct()
    split = opened.join(closed.withColumnRenamed("closer", "opener"), ["file_id", "cursor", "opener"], "left_anti").join(closed.select("file_id", "cursor").distinct(), ["file_id", "cursor"], "left_semi")
    direct = closed.join(calls.select("file_id", F.col("src").alias("opener"), F.col("dst").alias("closer")).distinct(), ["file_id", "closer"]).select("file_id", "cursor", "opener").distinct()
    return split.join(direct, ["file_id", "cursor", "opener"], "left_anti").select("file_id", "cursor", "opener", F.col("line_no").cast("long").alias("line_no"))


def next_segment(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """J9, as-of: each block with the first C segment of the same function, or of no function, that starts after it;
    nulls if there is none.

    One window over blocks and segments of a function, sorted by line: no pairs are made."""
    none = F.lit(None).cast("long")
    b = blocks.select("file_id", "func_name", F.col("line_end").alias("at"), F.lit(1).alias("o"), "block_no", none.alias("start"), none.alias("end"), F.lit(None).cast("boolean").alias("error_path"))
    s = segments.select("file_id", "func_name", F.col("line_start").alias("at"), F.lit(0).alias("o"), none.alias("block_no"), F.col("line_start").alias("start"), F.col("line_end").alias("end"), "error_path")
    w = Window.partitionBy("file_id", "func_name").orderBy("at", "o").rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.when(F.col("o") == 0, F.struct("start", "end", "error_path")), ignorenulls=True).over(w)
    return b.union(s).withColumn("n", first).where("o = 1").select("file_id", "block_no", F.col("n.start").alias("segment_start"), F.col("n.end").alias("segment_end"), F.col("n.error_path").alias("error_path"))


def no_error_path(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """K5: DML whose result is checked and whose next C segment in the function has no way out; none where there is no
    such segment."""
    near = next_segment(blocks, segments).where("segment_start is not null and not error_path")
    rows = blocks.where(F.col("kind").isin(*DML) & F.col("has_sqlca_check")).join(near, ["file_id", "block_no"])
    return rows.select(*_finding("CROSS_SQLCA_NO_ERROR_PATH", "medium", "data_integrity", F.col("line_end")), F.col("segment_end").alias("line_end"))


def transaction_split(blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """K6: a function with DML that commits nothing and has no direct call, either way, with one that does. Files
    without calls, without DML or without transaction points are skipped; rows are in no order."""
    dml = blocks.where(F.col("kind").isin(*DML) & F.col("func_name").isNotNull()).groupBy("file_id", "func_name").agg(F.min("line_start").alias("line_no"))
    tx = blocks.where(F.col("kind").isin("COMMIT", "ROLLBACK") & F.col("func_name").isNotNull()).select("file_id", "func_name").distinct()
    linked = calls.select("file_id", F.col("src").alias("func_name"), F.col("dst").alias("other")).union(calls.select("file_id", "dst", "src")).distinct()
    near = linked.join(tx.withColumnRenamed("func_name", "other"), ["file_id", "other"], "left_semi").select("file_id", "func_name").distinct()
    some = dml.join(tx.select("file_id").distinct(), "file_id", "left_semi").join(calls.select("file_id").distinct(), "file_id", "left_semi")
    return some.join(tx, ["file_id", "func_name"], "left_anti").join(near, ["file_id", "func_name"], "left_anti").select("file_id", "func_name", F.col("line_no").cast("long").alias("line_no"))


def call_edges(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """CALLS(file_id, src, dst, line_no): a known function's name before a parenthesis within another function."""
    from .search import enclosing

    names = F.array_distinct(F.regexp_extract_all("raw", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))
    rows = enclosing(lines.where(~F.col("raw").rlike(r"(?i)\bEXEC\s+SQL\b")).select("file_id", "line_no", F.explode(names).alias("dst")), spans).where("func_name is not null and func_name <> dst")
    return rows.join(spans.select("file_id", F.col("func_name").alias("dst")).distinct(), ["file_id", "dst"], "left_semi").select("file_id", F.col("func_name").alias("src"), "dst", "line_no")


def symbol_graph(spans: DataFrame, blocks: DataFrame, calls: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """H4: graph_edge(file_id, src, dst, edge_type, n): functions, SQL blocks, host variables, cursors, transactions, and
    the functions in which host_variables() says that variables are declared."""
    func, sql = F.concat(F.lit("func:"), F.col("func_name")), F.concat(F.lit("sql:"), F.col("block_no").cast("string"))
    cursor = F.concat(F.lit("cursor:"), F.regexp_extract("sql_text", r"(?i)^\w+\s+(\w+)", 1))
    edge = lambda d, a, b, kind: d.select("file_id", a.alias("src"), b.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"))
    inside = blocks.where("func_name is not null")
    edges = edge(inside, func, sql, "CONTAINS")
    edges = edges.union(edge(blocks.select("*", F.explode("host_vars").alias("v")), sql, F.concat(F.lit("hvar:"), F.col("v")), "USES_HOST_VAR"))
    edges = edges.union(edge(blocks.where(F.col("kind").isin(*EVENTS)), sql, cursor, F.concat(F.col("kind"), F.lit("_CURSOR"))))
    edges = edges.union(edge(inside.where(F.col("kind").isin("COMMIT", "ROLLBACK", "SAVEPOINT")), func, F.concat(F.lit("tx:"), F.col("kind")), "HAS_TRANSACTION"))
    edges = edges.union(edge(blocks.where("has_sqlca_check"), sql, sql, "CHECKS_ERROR"))
    edges = edges.union(edge(calls, F.concat(F.lit("func:"), F.col("src")), F.concat(F.lit("func:"), F.col("dst")), "CALLS"))
    if variables is not None:
        edges = edges.union(edge(variables.where("func_name is not null"), F.concat(F.lit("hvar:"), F.col("name")), func, "DECLARED_IN"))
    return edges.groupBy("file_id", "src", "dst", "edge_type").agg(F.count("*").alias("n"))


def duplicate_closes(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """A cursor closed on two or more lines of one function: (file_id, func_name, cursor, close_lines)."""
    from .search import enclosing

    p = r"(?i)\b(?:DBIO_CLOSE\s*\(\s*|EXEC\s+SQL\s+CLOSE\s+)(\w+)"
    rows = enclosing(lines.where(F.col("raw").rlike(p)).select("file_id", "line_no", F.regexp_extract("raw", p, 1).alias("cursor")), spans)
    at = F.array_sort(F.collect_set("line_no"))
    return rows.groupBy("file_id", "func_name", "cursor").agg(at.alias("at")).where(F.size("at") >= 2).select("file_id", "func_name", "cursor", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("close_lines"))


def adjacent(edges: DataFrame, node: str, outgoing: bool = True, edge_type: str | None = None) -> DataFrame:
    """H6: the edges that leave or reach a node, of one type if given."""
    rows = edges.where(F.col("src" if outgoing else "dst") == node)
    return rows if edge_type is None else rows.where(F.col("edge_type") == edge_type)


def in_group(rows: DataFrame, spans: DataFrame, groups: DataFrame, by_name: bool = True) -> DataFrame:
    """rows(file_id, line_no, func_name) with the group_no of groups(file_id, group_no, func_name) whose functions
    hold their line or, if `by_name`, are theirs; once for each group. Equi joins by file and by function; the range is
    a residual."""
    ranges = groups.join(spans.select("file_id", "func_name", "line_start", "line_end"), ["file_id", "func_name"])
    keyed = rows.withColumn("_row", F.struct(*rows.columns))
    at = keyed.join(ranges.select("file_id", "group_no", "line_start", "line_end"), "file_id").where("line_no between line_start and line_end").select("_row", "group_no")
    if by_name:
        at = at.union(keyed.join(groups, ["file_id", "func_name"]).select("_row", "group_no"))
    return at.distinct().select("_row.*", "group_no")


def cross_checks(parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """K0 to K7 over what structure.regions() has parsed: (file_id, rule_id, severity, line_no). A file without functions,
    statements and variables has no graph, and no check."""
    from . import structure as X

    some = parsed.where((F.size("r.spans") > 0) | (F.size("r.blocks") > 0) | (F.size("r.declared") > 0)).select("file_id")
    blocks, spans, segments = X.sql_blocks(parsed), X.parsed_spans(parsed), X.c_segments(parsed)
    variables, events, edges = X.host_variables(parsed, blocks), X.cursor_events(blocks), call_edges(lines, spans)
    named = lambda d, rule, severity: d.select("file_id", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "line_no")
    parts = [
        named(undeclared_host_vars(blocks, variables.where("c_type <> 'unknown'")), "CROSS_HOST_VAR_UNDECLARED", "critical"),
        named(type_mismatches(blocks, variables), "CROSS_HOST_VAR_TYPE_MISMATCH", "high"),
        named(cursor_function_split(events, edges), "CROSS_CURSOR_FUNC_SPLIT", "high"),
        cursor_rules(cursor_lifecycle(events)).where("rule_id = 'CROSS_CURSOR_INCOMPLETE'").select("file_id", "rule_id", "severity", "line_no"),
        no_error_path(blocks, segments).select("file_id", "rule_id", "severity", "line_no"),
        named(transaction_split(blocks, edges), "CROSS_TRANSACTION_SPLIT", "medium"),
        file_rules(blocks).where("rule_id = 'CROSS_TRANSACTION_MISSING_ROLLBACK'").select("file_id", "rule_id", "severity", "line_no"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(some.distinct(), "file_id", "left_semi")
