"""Queries on SQL text and explain plans, both made from relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators import sql_lint as Q
from ._base import query, table

_SQL = """select o_orderkey as file_id, 'SELECT ' || case o_custkey % 4 when 0 then '*' when 1 then 'a, UPPER(b)' when 2 then 'count(c' else '(a + b))' end || chr(10)
 || case o_custkey % 5 when 0 then 'FROM t1 -- it (is 1-2' when 1 then '' when 2 then 'FROM t1 JOIN t2 ON t1.id = t2.id' when 3 then 'FROM t1 /* note; (x */' else 'FROM t1' end || chr(10)
 || case o_orderkey % 4 when 0 then 'WHERE name LIKE ''%x;1-2''' when 1 then 'WHERE UPPER(name) = ''it''''s''' when 2 then 'WHERE a = 1 OR b = ''-- no''' else 'ORDER BY a' end || ';' || chr(10)
 || case o_orderkey % 5 when 0 then 'UPDATE t SET a = 1;' when 1 then 'DELETE FROM t;' when 2 then 'UPDATE t SET a = 1 WHERE id = 2;' when 3 then 'DELETE FROM t WHERE id IN (SELECT id FROM s);' else 'SELECT 1' end as content from orders"""
_DUCK = f"sql_file as ({_SQL}), line as (select file_id, i as line_no, l[i] as raw from (select file_id, l, unnest(range(1, len(l) + 1)) as i from (select file_id, string_split(content, chr(10)) as l from sql_file)))"
_BARE = _DUCK + """, bare as (select file_id, regexp_replace(regexp_replace(regexp_replace(content, '''([^'']|'''')*''', '''''', 'g'), '--[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'g') as code from sql_file)"""


def _files(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("sparkloupe_orders")
    return spark.sql(_SQL.replace("from orders", "from sparkloupe_orders"))


def _lines(spark, sf_dir):
    return S.source_lines(_files(spark, sf_dir))


@query(f"with {_DUCK} select file_id, regexp_replace(regexp_replace(content, '-- it \\(is 1-2', ''), '/\\* note; \\(x \\*/', '') as code from sql_file")
def p4_strip_sql(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.strip_sql(F.col("content")).alias("code"))


@query(f"with {_DUCK} select file_id, replace(content, 'x;1-2''', 'x;1*2''') as code from sql_file")
def p6_star_hyphens(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.star_hyphens(F.col("content"), sql=True).alias("code"))


_SEARCH = " union all ".join(f"select file_id, line_no, '{n}' as pattern, {m} as match, null::varchar as capture from line where {w}" for n, m, w in (
    ("select_star", "'SELECT *'", "starts_with(raw, 'SELECT *')"),
    ("function_in_where", "'WHERE UPPER('", "starts_with(raw, 'WHERE UPPER(')"),
    ("like_wildcard", "'LIKE ''%'", "contains(raw, 'LIKE ''%')"),
    ("subquery", "'(SELECT'", "contains(raw, '(SELECT')"),
    ("join", "'JOIN'", "contains(raw, ' JOIN ')"),
    ("or_condition", "'OR'", "contains(raw, ' OR ')"),
))


@query(f"with {_DUCK} {_SEARCH}")
def g2_structural_sql(spark, sf_dir):
    return S.structural_search(_lines(spark, sf_dir), "sql")


@query(f"with {_BARE}, m as (select file_id, i, case substr(code, i, 1) when '(' then 1 when ')' then -1 else 0 end as d from (select file_id, code, unnest(range(1, length(code) + 1)) as i from bare)), r as (select file_id, i, sum(d) over (partition by file_id order by i) as s from m), x as (select file_id, coalesce(-least(min(s), 0), 0) as stray, max_by(s, i) as last from r group by file_id) select file_id, (last + stray)::bigint as unclosed, stray::bigint as stray from x where last + stray + stray > 0")
def q1_paren_balance(spark, sf_dir):
    return Q.paren_balance(_files(spark, sf_dir))


#: The parentheses of the text that have no partner, by what it is made of.
@query("select o_orderkey as file_id, p.paren, p.line_no from orders, (values (2, '(', 1::bigint), (3, ')', 1::bigint)) p(k, paren, line_no) where o_custkey % 4 = p.k")
def q1_unmatched_parens(spark, sf_dir):
    return Q.unmatched_parens(_files(spark, sf_dir))


@query(f"with {_DUCK}, c as (select file_id, line_no, regexp_replace(regexp_replace(raw, '''''', '', 'g'), '--.*$|/\\*.*?\\*/', '', 'g') as c from line) select file_id, line_no from c where (length(c) - length(replace(c, '''', ''))) % 2 = 1")
def q2_unclosed_quotes(spark, sf_dir):
    return Q.unclosed_quotes(_lines(spark, sf_dir))


_STATEMENT = _BARE + """, stmt as (select file_id, row_number() over (partition by file_id order by i) as statement_no, s as statement, case i when 1 then 1 when 2 then 4 else 5 end::bigint as line_no from (select file_id, i, trim(regexp_replace(p[i], '\\s+', ' ', 'g')) as s from (select file_id, p, unnest(range(1, len(p) + 1)) as i from (select file_id, string_split(code, ';') as p from bare))) where s <> '')"""


@query(f"with {_STATEMENT} select * from stmt")
def q5_statements(spark, sf_dir):
    """Q5 and Q6."""
    return Q.statements(_files(spark, sf_dir))


@query(f"with {_STATEMENT} select file_id, statement_no, line_no, 'missing_from' as rule, 'error' as level from stmt where statement like 'SELECT%' and not regexp_matches(statement, '\\bFROM\\b') and not regexp_matches(statement, '^SELECT [0-9]+') union all select file_id, statement_no, line_no, 'update_without_where', 'warning' from stmt where statement like 'UPDATE%' and statement not like '% WHERE %' union all select file_id, statement_no, line_no, 'delete_without_where', 'warning' from stmt where statement like 'DELETE%' and statement not like '% WHERE %'")
def q3_statement_rules(spark, sf_dir):
    """Q3 and Q4, by the text rules of Q5."""
    return Q.statement_rules(Q.statements(_files(spark, sf_dir)))


#: A plan of an order's lines: a step for each, numbered within the order.
_STEP = """select l_orderkey as plan_id, cast(id as bigint) as id, case l_partkey % 8 when 0 then 'TABLE ACCESS FULL' when 1 then 'MERGE JOIN CARTESIAN' when 2 then 'INDEX RANGE SCAN' when 3 then 'HASH JOIN' when 4 then 'INDEX UNIQUE SCAN' when 5 then 'SORT ORDER BY' when 6 then 'NESTED LOOPS' else 'TABLE ACCESS BY INDEX ROWID' end as operation,
 case l_suppkey % 4 when 0 then 'ORDERS_PK' when 1 then 'CUSTOMERS' when 2 then 'ITEMS_N1' else 'PARTS' end as name, cast(l_quantity * 5000 as bigint) as rows, cast(l_quantity * 100 as bigint) as bytes, cast(floor(l_extendedprice / case when l_orderkey % 2 = 0 then 5 else 150 end) as bigint) as cost
 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id from lineitem) l"""
_STEPS = f"step as ({_STEP})"
#: Predicates of each step, two lines of them.
_PREDICATES = ('"A"."ID"="B"."ID"', '"B"."NO"=1 AND "A"."ID">0')
_NUMBER = "(case when {0} >= 1000000 then (floor({0} / 1000000)::bigint)::varchar || ',' || lpad((floor({0} / 1000)::bigint % 1000)::varchar, 3, '0') || ',' || lpad(({0} % 1000)::varchar, 3, '0') else (floor({0} / 1000)::bigint)::varchar || ',' || lpad(({0} % 1000)::varchar, 3, '0') end)"
_POINTS = (
    _STEPS
    + f""", lab as (select *, case operation when 'TABLE ACCESS FULL' then 'full table scan' when 'MERGE JOIN CARTESIAN' then 'cartesian product' when 'SORT ORDER BY' then 'large sort' when 'HASH JOIN' then 'hash join' when 'NESTED LOOPS' then 'nested loops' end as label,
 case operation when 'TABLE ACCESS FULL' then 'Full Table Scan — 인덱스 생성 또는 WHERE 조건 추가 권장' when 'MERGE JOIN CARTESIAN' then 'Cartesian Join — JOIN 조건이 누락되었을 수 있음' when 'SORT ORDER BY' then '대량 정렬 — 인덱스 활용 또는 정렬 최소화 검토' when 'HASH JOIN' then 'Hash Join — 대량 데이터 JOIN 시 메모리 사용량 확인 필요' when 'NESTED LOOPS' then 'Nested Loops — 드라이빙 테이블 크기가 크면 성능 저하' end as said,
 operation = 'INDEX RANGE SCAN' and cost >= 100 and name = 'ORDERS_PK' as pk from step),
 point as (select plan_id, id as step_id, operation, name, cost, rows,
 case when label is not null then label when cost >= 1000 then 'high cost' when pk then 'primary key range scan' when rows >= 100000 then 'many rows' end as reason,
 case when operation = 'MERGE JOIN CARTESIAN' then 'critical' when operation = 'TABLE ACCESS FULL' then case when cost >= 1000 or rows >= 100000 then 'high' else 'medium' end when cost >= 10000 then 'high' when label is null and cost < 1000 and pk then 'high' else 'medium' end as severity,
 case when label is not null then said when cost >= 1000 then 'Cost가 ' || cost || '으로 높음 — 쿼리 최적화 필요' when pk then 'PK 인덱스 사용이지만 Cost=' || cost || '으로 높음 — 조인 컬럼 (id, no) 기반 인덱스 힌트 검토: /*+ INDEX(alias (id, no)) */' else '예상 행 수가 ' || {_NUMBER.format('rows')} || '건으로 많음 — 필터링 조건 검토' end as suggestion from lab)"""
)
_POINT = _POINTS + ", points as (select * from point where reason is not null)"


def _steps(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("sparkloupe_lineitem")
    return spark.sql(_STEP.replace("from lineitem", "from sparkloupe_lineitem"))


def _table_text(steps):
    """Each plan as a table, as a database prints it."""
    line = F.concat_ws(" | ", F.lit(""), F.concat(F.lit("* "), F.col("id").cast("string")), F.concat(F.lit("  "), "operation"), "name", F.col("rows").cast("string"), F.lit(""), F.concat(F.col("cost").cast("string"), F.lit(" (10)")), F.lit(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]), "\n")
    return steps.groupBy("plan_id").agg(F.concat(F.lit("---\n | Id | Operation | Name | Rows | Bytes | Cost (%CPU) |\n---\n"), body).alias("content"))


@query(f"with {_STEPS} select plan_id, id, operation, name, rows, cast(null as bigint) as bytes, cost from step")
def q7_plan_table(spark, sf_dir):
    """Plans printed as tables and parsed again give the same steps; bytes are left empty."""
    return Q.plan_steps(_table_text(_steps(spark, sf_dir)))


@query(f"with {_STEPS} select plan_id, id - 1 as id, operation, name, rows, bytes, cost, [name || '.ID = 1', 'x'] as predicates from step")
def q8_plan_dump(spark, sf_dir):
    """Plans printed as text dumps, with FULL in parentheses, and parsed again."""
    steps = _steps(spark, sf_dir)
    shown = F.regexp_replace("operation", " FULL$", " (FULL)")
    line = F.concat(F.lit("  "), shown, F.lit(" OF 'APP."), "name", F.lit("' (Cost="), F.col("cost").cast("string"), F.lit(" Card="), F.col("rows").cast("string"), F.lit(" Bytes="), F.col("bytes").cast("string"), F.lit(")\n 12\n KEY\n "), "name", F.lit(".ID = 1\n\n x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]), "\n")
    plans = steps.groupBy("plan_id").agg(F.concat(F.lit("Operation\nObject Instance\nAccess Pred\nFilter Pred\n"), body).alias("content"))
    return Q.plan_steps_dump(plans.where(Q.is_text_dump(F.col("content"))))


@query(f"with {_STEPS} select plan_id, id, operation, name, rows, bytes, cost from step")
def q9_plan_plain(spark, sf_dir):
    line = F.concat(F.col("id").cast("string"), F.lit(" "), "operation", F.lit("  "), F.lower("name"), F.lit(" cost="), F.col("cost").cast("string"), F.lit(" rows="), F.col("rows").cast("string"), F.lit(" bytes="), F.col("bytes").cast("string"))
    text = _steps(spark, sf_dir).groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    return Q.plan_steps_plain(text).withColumn("name", F.upper("name"))


@query(f"with {_STEPS} select plan_id, 'Id | Operation | Object | Cost | Rows' || chr(10) || '---|-----------|--------|------|-----' || chr(10) || string_agg(id || ' | ' || operation || ' | ' || name || ' | ' || cost || ' | ' || rows, chr(10) order by id) || chr(10) || chr(10) || 'Predicate Information:' || chr(10) || string_agg('  ' || id || ' - \"A\".\"ID\"=\"B\".\"ID\"' || chr(10) || '  ' || id || ' - ' || repeat('x', 200) || '...', chr(10) order by id) as text from step group by plan_id")
def q10_plan_text(spark, sf_dir):
    """Q10, with a short predicate and one that is cut."""
    return Q.plan_text(_steps(spark, sf_dir).withColumn("predicates", F.array(F.lit(_PREDICATES[0]), F.lit("x" * 250))))


def _points(spark, sf_dir):
    return Q.tuning_points(_steps(spark, sf_dir).withColumn("predicates", F.array(*[F.lit(p) for p in _PREDICATES])))


@query(f"with {_POINT} select * from points")
def q11_tuning_points(spark, sf_dir):
    """Q11 to Q15."""
    return _points(spark, sf_dir)


_ISSUE = (
    _POINT
    + """, shaped as (select plan_id, step_id, reason, case operation when 'MERGE JOIN CARTESIAN' then 'critical' else 'high' end as severity,
 case operation when 'MERGE JOIN CARTESIAN' then 'MERGE JOIN CARTESIAN 발생 — JOIN 조건 누락 가능' when 'INDEX RANGE SCAN' then 'PK 인덱스 비효율 — ORDERS_PK Cost=' || cost else 'Full Table Scan — ' || name || case when cost > 0 then ' Cost=' || cost else '' end end as title,
 case operation when 'MERGE JOIN CARTESIAN' then operation when 'INDEX RANGE SCAN' then 'INDEX RANGE SCAN (ORDERS_PK)' else 'TABLE ACCESS FULL (' || name || ')' end as before,
 case operation when 'MERGE JOIN CARTESIAN' then 'JOIN 조건을 추가하여 Cartesian Product를 방지' when 'INDEX RANGE SCAN' then case when reason = 'high cost' then '조인 컬럼 기반 인덱스 힌트 추가 필요' else '/*+ INDEX(alias (id, no)) */' end else '/*+ INDEX(' || lower(name) || ' (조건_컬럼)) */' end as after
 from points where severity in ('critical', 'high') and (operation in ('MERGE JOIN CARTESIAN', 'TABLE ACCESS FULL') or operation = 'INDEX RANGE SCAN' and name = 'ORDERS_PK')),
 numbered as (select *, printf('SQL-S%03d', row_number() over (partition by plan_id order by step_id)) as issue_id from shaped),
 issue as (select plan_id, step_id, issue_id, severity, title, before, after from numbered qualify row_number() over (partition by plan_id, before order by step_id) = 1)"""
)


@query(f"with {_ISSUE} select * from issue")
def q16_plan_issues(spark, sf_dir):
    """Q16 and W11."""
    return Q.plan_issues(_points(spark, sf_dir))


@query(f"with {_ISSUE}, kept as (select * from issue i where plan_id % 2 = 1 or not ((before like '%CUSTOMERS%') or (before like '%ITEMS%') or (before like '%JOIN%'))) select * replace (printf('SQL-%03d', row_number() over (partition by plan_id order by step_id)) as issue_id) from kept")
def q17_not_reviewed(spark, sf_dir):
    """Every plan with an even id has a review that names tables."""
    steps = _steps(spark, sf_dir)
    reviews = steps.where("plan_id % 2 = 0").select("plan_id").distinct().withColumn("text", F.lit("Join of customers and items by merge"))
    return Q.not_reviewed(Q.plan_issues(_points(spark, sf_dir)), reviews)


@query(f"with {_POINT}, r as (select *, row_number() over (partition by plan_id order by case severity when 'critical' then 0 when 'high' then 1 else 2 end, cost desc, step_id) as rank from points) select * from r where rank <= 3")
def q18_top_points(spark, sf_dir):
    """Q18 and W17."""
    return Q.top_points(_points(spark, sf_dir), 3)


@query(f"with {_STEPS}, n as (select *, count(*) over (partition by plan_id) as n from step) select * exclude (n) from n where n <= 4 or cost >= 50 or regexp_matches(operation, 'TABLE ACCESS|MERGE JOIN|CARTESIAN')")
def q18_excerpt(spark, sf_dir):
    return Q.excerpt(_steps(spark, sf_dir), 4)


@query("select p_partkey as plan_id, substr(repeat('plan ', p_size * 60), 1, 8000) as content from part")
def q18_raw_excerpt(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return Q.raw_excerpt(part.select(F.col("p_partkey").alias("plan_id"), F.repeat(F.lit("plan "), F.col("p_size") * 60).alias("content")))
