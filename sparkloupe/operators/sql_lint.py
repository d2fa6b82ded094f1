"""SQL text rules and explain-plan analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Inefficient operations in order, what we call them, and what to do; the first that a step's operation
#: holds counts.
INEFFICIENT = (
    ("TABLE ACCESS FULL", "full table scan", "Full Table Scan — 인덱스 생성 또는 WHERE 조건 추가 권장"),
    ("CARTESIAN", "cartesian product", "Cartesian Join — JOIN 조건이 누락되었을 수 있음"),
    ("SORT MERGE JOIN", "sort merge join", "Sort Merge Join — 대량 데이터에서 성능 저하 가능, Nested Loop 또는 Hash Join 검토"),
    ("MERGE JOIN CARTESIAN", "cartesian product", "Cartesian Merge Join — JOIN 조건 누락 확인 필요"),
    ("SORT ORDER BY", "large sort", "대량 정렬 — 인덱스 활용 또는 정렬 최소화 검토"),
    ("HASH JOIN", "hash join", "Hash Join — 대량 데이터 JOIN 시 메모리 사용량 확인 필요"),
    ("NESTED LOOPS", "nested loops", "Nested Loops — 드라이빙 테이블 크기가 크면 성능 저하"),
)
#: Starts of operation lines in a text dump.
OPERATIONS = (
    "SELECT STATEMENT", "UPDATE STATEMENT", "DELETE STATEMENT", "INSERT STATEMENT", "TABLE ACCESS", "INDEX", "SORT", "FILTER", "COUNT", "VIEW", "NESTED LOOP", "MERGE JOIN",
    "HASH JOIN", "HASH GROUP", "HASH UNIQUE", "UNION", "PARTITION", "BUFFER", "SEQUENCE", "MINUS", "INTERSECT", "CONNECT BY", "INLIST", "CARTESIAN", "MAT_VIEW", "WINDOW",
    "COLLECTION", "PX", "CONCATENATION", "BITMAP", "REMOTE", "LOAD", "TEMP TABLE", "RECURSIVE",
)
HIGH_COST, VERY_HIGH_COST, PK_COST, MANY_ROWS = 1000, 10000, 100, 100000
#: Texts of the issues that plans give.
CARTESIAN_TITLE, CARTESIAN_AFTER = "MERGE JOIN CARTESIAN 발생 — JOIN 조건 누락 가능", "JOIN 조건을 추가하여 Cartesian Product를 방지"
PK_AFTER = "조인 컬럼 기반 인덱스 힌트 추가 필요"
STOP_WORDS = ("table", "access", "full", "index", "scan", "range", "plan", "cost", "rows", "step", "with", "from", "where", "select")
#: Strings of both kinds, comments, and what is between them.
_QUOTED = rf"""(?s)'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|--[^\n]*+|/\*.*?(?:\*/|\z)|[^'"/-]++|."""


def _code(text: Column) -> Column:
    """Comments dropped, strings emptied."""
    return T.rewrite(T.strip_sql(text), T.SQL_TOKENS, lambda t: F.when(t.startswith("'") & (F.length(t) > 1), F.lit("''")).otherwise(t))


def _breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", "")


def unmatched_parens(files: DataFrame) -> DataFrame:
    """Q1: (file_id, paren, line_no): stray closing and leftover opening parentheses outside strings and comments; a
    quote of one kind within a string of the other is no quote. A fold over parentheses and line breaks whose state is
    the open ones."""
    bare = T.rewrite(F.col("content"), _QUOTED, lambda t: F.when(t.rlike(r"""^(['"]|--|/\*)"""), _breaks(t)).otherwise(t))
    marks = F.regexp_extract_all(bare, F.lit(r"[()\n]"), F.lit(0))
    none = F.array().cast("array<long>")
    begin = F.struct(F.lit(1).cast("long").alias("line"), none.alias("open"), none.alias("stray"))
    state = lambda line, opened, stray: F.struct(line.alias("line"), opened.alias("open"), stray.alias("stray"))

    def step(a: Column, m: Column) -> Column:
        more = lambda xs: F.concat(xs, F.array(a["line"]))
        closed = F.when(F.size(a["open"]) > 0, F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0)))).otherwise(a["open"])
        return F.when(m == "\n", state(a["line"] + 1, a["open"], a["stray"])).when(m == "(", state(a["line"], more(a["open"]), a["stray"])).otherwise(state(a["line"], closed, F.when(F.size(a["open"]) == 0, more(a["stray"])).otherwise(a["stray"])))

    rows = files.select("file_id", F.aggregate(marks, begin, step).alias("p"))
    found = F.concat(F.transform("p.stray", lambda x: F.struct(F.lit(")").alias("paren"), x.alias("line_no"))), F.transform("p.open", lambda x: F.struct(F.lit("(").alias("paren"), x.alias("line_no"))))
    return rows.select("file_id", F.inline(found))


def paren_balance(files: DataFrame) -> DataFrame:
    """Q1: their numbers by file."""
    return unmatched_parens(files).groupBy("file_id").agg(F.count_if(F.col("paren") == "(").alias("unclosed"), F.count_if(F.col("paren") == ")").alias("stray"))


def unclosed_quotes(lines: DataFrame) -> DataFrame:
    """Q2: lines with an odd number of quotes, doubled ones and comments aside; strings over several lines count, too."""
    code = F.regexp_replace(F.regexp_replace("raw", "''", ""), r"--.*$|/\*.*?\*/", "")
    return lines.where((F.length(code) - F.length(F.replace(code, F.lit("'"), F.lit("")))) % 2 == 1).select("file_id", "line_no")


def statements(files: DataFrame) -> DataFrame:
    """(file_id, statement_no, statement, line_no): split at semicolons outside strings and comments; blank ones don't
    count. Q6: line_no is where the statement's text starts, by offset."""
    lines = T.rewrite(F.col("content"), T.SQL_TOKENS, lambda t: F.when(t.startswith("--") | (t.startswith("/*") & ~t.rlike(T.HINT)), _breaks(t)).when(t.startswith("'") & (F.length(t) > 1), F.concat(F.lit("'"), _breaks(t))).otherwise(t))
    rows = files.select("file_id", F.split(_code(F.col("content")), ";").alias("s"), F.split(lines, ";").alias("l"))
    rows = rows.select("file_id", "l", F.posexplode("s").alias("pos", "s"))
    text = F.regexp_replace(F.trim(F.regexp_replace("s", r"\s+", " ")), "^ | $", "")
    before = F.concat(F.array_join(F.slice("l", F.lit(1), F.col("pos")), ""), F.regexp_extract(F.element_at("l", F.col("pos") + 1), r"^(\s*)", 1))
    return rows.select("file_id", (F.col("pos") + 1).cast("long").alias("statement_no"), text.alias("statement"), (F.regexp_count(before, F.lit("\n")) + 1).cast("long").alias("line_no")).where("statement <> ''")


def statement_rules(rows: DataFrame) -> DataFrame:
    """Q3 to Q5: SELECT without FROM (constants aside), UPDATE and DELETE without WHERE anywhere in the statement."""
    s = F.col("statement")
    constant = s.rlike(r"(?i)^SELECT\s+(?:[0-9]+|''|SYSDATE|NULL|USER)\b|(?i)^SELECT\s+''")
    rules = (("missing_from", "error", s.rlike(r"(?i)^SELECT\b") & ~s.rlike(r"(?i)\bFROM\b") & ~constant), ("update_without_where", "warning", s.rlike(r"(?i)^UPDATE\b") & ~s.rlike(r"(?i)\bWHERE\b")), ("delete_without_where", "warning", s.rlike(r"(?i)^DELETE\b") & ~s.rlike(r"(?i)\bWHERE\b")))
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(v).alias("level"))) for n, v, c in rules]), lambda x: x.isNotNull())
    return rows.select("file_id", "statement_no", "line_no", F.explode(hits).alias("h")).select("file_id", "statement_no", "line_no", "h.rule", "h.level")


def plan_steps(plans: DataFrame) -> DataFrame:
    """Q7: plan_step of plans(plan_id, content) in table form. Columns come from the header, which has Id and Operation;
    numbers are read after a bracketed part is dropped; empty cells are null; rows without an id don't count."""
    rows = plans.select("plan_id", F.posexplode(T.lines(F.col("content"))).alias("no", "line")).where(F.col("line").rlike(r"^\s*\|.*\|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.select("plan_id", "no", cells.alias("cells"))
    is_head = F.exists("cells", lambda c: F.lower(c) == "id") & F.exists("cells", lambda c: F.lower(c) == "operation")
    names = F.transform("cells", lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\(.*?\)", "")), " +", "_"))
    w = Window.partitionBy("plan_id").orderBy("no")
    rows = rows.withColumn("head", F.last(F.when(is_head, names), ignorenulls=True).over(w)).where(F.col("head").isNotNull() & ~is_head & (F.size("cells") == F.size("head")))
    cell = lambda n: F.nullif(F.get("cells", F.array_position("head", n).cast("int") - 1), F.lit(""))
    number = lambda n: F.expr(f"try_cast(regexp_replace(nullif(get(cells, cast(array_position(head, '{n}') as int) - 1), ''), '[(].*?[)]|[*]| ', '') as bigint)")
    return rows.select("plan_id", number("id").alias("id"), cell("operation").alias("operation"), cell("name").alias("name"), number("rows").alias("rows"), number("bytes").alias("bytes"), number("cost").alias("cost")).where("id is not null")


def plan_steps_plain(plans: DataFrame) -> DataFrame:
    """Q9: plan_step of lines like `id OPERATION name cost=.. rows=.. bytes=..`."""
    p = r"^\s*(\d+)\s+([A-Z]+(?: [A-Z]+)*)(?:\s{2,}(\w+))?\s+cost=(\d+)(?:\s+rows=(\d+))?(?:\s+bytes=(\d+))?"
    rows = plans.select("plan_id", F.explode(T.lines(F.col("content"))).alias("line")).where(F.col("line").rlike(p))
    text = lambda i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    return rows.select("plan_id", text(1).cast("long").alias("id"), text(2).alias("operation"), text(3).alias("name"), text(5).cast("long").alias("rows"), text(6).cast("long").alias("bytes"), text(4).cast("long").alias("cost"))


def is_text_dump(content: Column) -> Column:
    """Q8: a plan whose first 500 characters name operations and predicates."""
    head = F.lower(F.left(content, F.lit(500)))
    return F.contains(head, F.lit("operation")) & (F.contains(head, F.lit("access pred")) | F.contains(head, F.lit("filter pred")))


def plan_steps_dump(plans: DataFrame) -> DataFrame:
    """Q8: plan_step of a text dump: operation lines start steps, counted from 0; other lines up to the next are their
    predicates, save bare numbers and KEY. Islands by a running count of operation lines; parentheses in operations
    are dropped."""
    op = "^(?:" + "|".join(OPERATIONS) + ")"
    line = F.trim("line")
    is_op = F.upper(line).rlike(op) & ~F.upper(line).startswith("FILTER PRED")
    rows = plans.select("plan_id", F.posexplode(F.split("content", "\n", -1)).alias("no", "line")).withColumn("line", F.regexp_replace(line, r"^\s+|\s+$", "")).withColumn("is_op", is_op)
    w = Window.partitionBy("plan_id").orderBy("no")
    rows = rows.withColumn("id", F.sum(F.col("is_op").cast("long")).over(w) - 1).where("id >= 0")
    number = lambda n: F.expr(f"try_cast(nullif(regexp_extract(line, '{n}=([0-9]+)', 1), '') as bigint)")
    named = F.regexp_extract("line", r"OF\s+'([^']+)'", 1)
    part = F.when(named != "", F.regexp_extract("line", r"^(.*?)OF\s+'", 1)).otherwise(F.regexp_replace("line", r"\s*\(Cost=.*$", ""))
    clean = F.trim(F.regexp_replace(F.translate(part, "()", "  "), r"\s+", " "))
    head = rows.where("is_op").select("plan_id", "id", clean.alias("operation"), F.nullif(F.substring_index(named, ".", -1), F.lit("")).alias("name"), number("Card").alias("rows"), number("Bytes").alias("bytes"), number("Cost").alias("cost"))
    said = rows.where(~F.col("is_op") & (F.col("line") != "") & ~F.col("line").rlike(r"^(\d+|KEY)$"))
    predicates = said.groupBy("plan_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", F.col("line").alias("t")))), lambda x: x["t"]).alias("predicates"))
    return head.join(predicates, ["plan_id", "id"], "left")


def plan_text(steps: DataFrame) -> DataFrame:
    """Q10: each plan as one text: a table with a line for each step, then predicates, if there, cut at 200 characters."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(" | ", *[text(c) for c in ("id", "operation", "name", "cost", "rows")])
    cut = lambda p: F.when(F.length(p) > 200, F.concat(F.left(p, F.lit(200)), F.lit("..."))).otherwise(p)
    some = F.col("predicates") if "predicates" in steps.columns else F.lit(None).cast("array<string>")
    said = F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda p: F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" - "), cut(p)))
    rows = steps.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("t"), said.alias("p")))).alias("x"))
    predicates = F.flatten(F.transform("x", lambda x: x["p"]))
    table = F.concat(F.array(F.lit("Id | Operation | Object | Cost | Rows"), F.lit("---|-----------|--------|------|-----")), F.transform("x", lambda x: x["t"]))
    all_lines = F.when(F.size(predicates) > 0, F.concat(table, F.array(F.lit(""), F.lit("Predicate Information:")), predicates)).otherwise(table)
    return rows.select("plan_id", F.array_join(all_lines, "\n").alias("text"))


def tuning_points(steps: DataFrame) -> DataFrame:
    """Q11 to Q15: one row for each step that an inefficient operation, its cost, a primary-key range scan or its rows
    single out, in that order, with what to do. Steps that share an id with an earlier reason suppress each other by
    that id. A primary-key scan's suggestion names the columns of its predicates, if the steps have any."""
    op, cost, rows = F.upper("operation"), F.coalesce("cost", F.lit(0)), F.coalesce("rows", F.lit(0))
    label = said = F.lit(None).cast("string")
    for text, name, suggestion in reversed(INEFFICIENT):
        label, said = F.when(op.contains(text), F.lit(name)).otherwise(label), F.when(op.contains(text), F.lit(suggestion)).otherwise(said)
    pk = op.contains("INDEX") & op.contains("RANGE SCAN") & (cost >= PK_COST) & F.upper("name").contains("_PK")
    reason = F.when(label.isNotNull(), label).when(cost >= HIGH_COST, "high cost").when(pk, "primary key range scan").when(rows >= MANY_ROWS, "many rows")
    full = op.contains("TABLE ACCESS FULL")
    severity = F.when(op.contains("CARTESIAN"), "critical").when(full, F.when((cost >= HIGH_COST) | (rows >= MANY_ROWS), "high").otherwise("medium")).when(cost >= VERY_HIGH_COST, "high").when(label.isNull() & (cost < HIGH_COST) & pk, "high").otherwise("medium")
    some = F.col("predicates") if "predicates" in steps.columns else F.lit(None).cast("array<string>")
    columns = F.array_distinct(F.flatten(F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda p: F.transform(F.regexp_extract_all(p, F.lit(r'"\w+"\."(\w+)"'), F.lit(1)), lambda c: F.lower(c)))))
    hint = F.when(F.size(columns) > 0, F.concat(F.lit(" ("), F.array_join(columns, ", "), F.lit(")"))).otherwise(F.lit(""))
    number = cost.cast("string")
    advice = F.when(label.isNotNull(), said).when(cost >= HIGH_COST, F.concat(F.lit("Cost가 "), number, F.lit("으로 높음 — 쿼리 최적화 필요")))
    advice = advice.when(pk, F.concat(F.lit("PK 인덱스 사용이지만 Cost="), number, F.lit("으로 높음 — 조인 컬럼"), hint, F.lit(" 기반 인덱스 힌트 검토: /*+ INDEX(alias"), hint, F.lit(") */")))
    advice = advice.otherwise(F.concat(F.lit("예상 행 수가 "), F.format_number(rows, 0), F.lit("건으로 많음 — 필터링 조건 검토")))
    order = F.when(label.isNotNull(), 0).otherwise(1)
    w = Window.partitionBy("plan_id", "id").orderBy("_order", F.desc_nulls_last("cost"), "operation", "name")
    out = steps.withColumns({"reason": reason, "severity": severity, "suggestion": advice, "_order": order}).where(F.col("reason").isNotNull())
    out = out.withColumn("_n", F.row_number().over(w)).where((F.col("_order") == 0) | (F.col("_n") == 1))
    return out.select("plan_id", F.col("id").alias("step_id"), "operation", "name", "cost", "rows", "reason", "severity", "suggestion")


def plan_issues(points: DataFrame) -> DataFrame:
    """Q16: critical and high points as issues of three shapes: cartesian products, primary-key scans and full scans;
    others give none. Numbered by step; then the first for each text before the fix."""
    op, name = F.upper("operation"), F.coalesce("name", F.lit(""))
    cost = F.when(F.coalesce("cost", F.lit(0)) != 0, F.concat(F.lit(" Cost="), F.col("cost").cast("string"))).otherwise(F.lit(""))
    product = op.contains("CARTESIAN")
    scan = op.contains("INDEX") & op.contains("RANGE SCAN") & F.upper(name).contains("_PK")
    full = op.contains("TABLE ACCESS FULL")
    hint = F.regexp_extract("suggestion", r"(/\*\+.*?\*/)", 1)
    in_parens = lambda text: F.concat(F.lit(f"{text} ("), name, F.lit(")"))
    title = F.when(product, F.lit(CARTESIAN_TITLE)).when(scan, F.concat(F.lit("PK 인덱스 비효율 — "), name, cost)).otherwise(F.concat(F.lit("Full Table Scan — "), name, cost))
    before = F.when(product, F.col("operation")).when(scan, in_parens("INDEX RANGE SCAN")).otherwise(in_parens("TABLE ACCESS FULL"))
    after = F.when(product, F.lit(CARTESIAN_AFTER)).when(scan, F.coalesce(F.nullif(hint, F.lit("")), F.lit(PK_AFTER))).otherwise(F.concat(F.lit("/*+ INDEX("), F.lower(name), F.lit(" (조건_컬럼)) */")))
    severity = F.when(product, "critical").otherwise("high")
    rows = points.where(F.col("severity").isin("critical", "high") & (product | scan | full))
    by_step = ["step_id", "reason", "operation", "name"]
    rows = rows.select("plan_id", "step_id", "reason", "operation", "name", severity.alias("severity"), title.alias("title"), before.alias("before"), after.alias("after"))
    rows = rows.withColumn("issue_id", F.format_string("SQL-S%03d", F.row_number().over(Window.partitionBy("plan_id").orderBy(*by_step))))
    w = Window.partitionBy("plan_id", "before").orderBy(*by_step)
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("plan_id", "step_id", "issue_id", "severity", "title", "before", "after")


def not_reviewed(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Q17: plan issues none of whose keywords a review of the plan mentions; without a keyword an issue stays. An equi
    join by plan, so the containment test is its residual. Renumbered SQL-nnn by plan."""
    word = F.filter(F.regexp_extract_all(F.lower("before"), F.lit(r"(\w+)"), F.lit(1)), lambda x: (F.length(x) > 3) & ~x.isin(*STOP_WORDS))
    text = reviews.groupBy("plan_id").agg(F.lower(F.concat_ws(" ", F.array_sort(F.collect_list("text")))).alias("_text"))
    base = F.transform(word, lambda x: F.regexp_replace(x, "_(pk|[nu][0-9]+|ix[0-9]+)$", ""))
    hit = F.exists(F.concat(word, base), lambda x: F.contains("_text", x))
    kept = issues.join(text, "plan_id", "left").where(~F.coalesce(hit, F.lit(False))).drop("_text")
    return kept.withColumn("issue_id", F.format_string("SQL-%03d", F.row_number().over(Window.partitionBy("plan_id").orderBy("step_id"))))


def top_points(points: DataFrame, k: int = 20) -> DataFrame:
    """Q18: the k most severe points of each plan, dearer ones first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    w = Window.partitionBy("plan_id").orderBy(rank, F.desc_nulls_last("cost"), "step_id")
    return points.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def excerpt(steps: DataFrame, most: int = 100) -> DataFrame:
    """Q18: of plans with more than `most` steps, those that cost 50 or access tables or join by merging."""
    n = F.count("*").over(Window.partitionBy("plan_id"))
    return steps.withColumn("_n", n).where((F.col("_n") <= most) | (F.col("cost") >= 50) | F.col("operation").rlike("TABLE ACCESS|MERGE JOIN|CARTESIAN")).drop("_n")


def raw_excerpt(plans: DataFrame, most: int = 8000) -> DataFrame:
    """Q18: plans(plan_id, content) cut at `most` characters."""
    return plans.select("plan_id", F.left("content", F.lit(most)).alias("content"))
