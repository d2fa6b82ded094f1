"""Queries on source text made from lineitem: lines, rules, spans, embedded SQL, cross checks, the symbol graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedded_sql as E
from ..operators import one_pass as O
from ..operators import search as S
from ..operators import structure as X
from ..plans import verdict
from ._base import ORACLES, PROC_DUCK, proc_lines, query

_FILES = PROC_DUCK + ", source_file as (select file_id, string_agg(raw, chr(10) order by line_no) as content from source_line group by file_id)"
_CODE = """code as (select *, regexp_replace(regexp_replace(regexp_replace(raw, '"[^"]*"', '""', 'g'), '/\\*.*\\*/', '', 'g'), '//.*$', '') as code from source_line)"""
_SPAN = "span as (select file_id, ln - 1 as fn, 'fn_' || ln as func_name, min(line_no) as line_start, max(line_no) as line_end, count(*) as line_count from source_line group by file_id, ln)"
_NAME = "'fn_' || ln"
_BLOCK = (
    _FILES
    + """, placed as (select *, sum(length(raw) + 1) over (partition by file_id order by line_no) - 1 as finish from source_line),
sqls as (select p.file_id, p.line_no as line_start, trim(regexp_replace(regexp_replace(p.raw, '^.*EXEC SQL ', ''), ';.*$', '')) as sql_text, """
    + _NAME
    + """ as func_name, substr(f.content, cast(finish as bigint) + 1, 200) as after from placed p join source_file f using (file_id) where p.raw like '%EXEC SQL %'),
w as (select *, regexp_matches(sql_text, '^WHENEVER') as is_w, last_value(case when regexp_matches(sql_text, '^WHENEVER') then sql_text end ignore nulls) over (partition by file_id order by line_start) as cur from sqls),
block as (select file_id, row_number() over (partition by file_id order by line_start) as block_no, line_start, line_start as line_end, func_name, sql_text,
  case when regexp_matches(sql_text, '^DECLARE') then 'DECLARE' else regexp_extract(sql_text, '^(\\w+)', 1) end as kind,
  list_distinct(regexp_extract_all(sql_text, ':(\\w+)', 1)) as host_vars, regexp_matches(after, '(?i)sqlca\\.sqlcode|WHENEVER +SQLERROR') as has_sqlca_check,
  case when cur like '%CONTINUE' then null else cur end as whenever from w where not is_w),
dml as (select * from block where kind in ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE'))"""
)
_EVENT = _BLOCK + ", event as (select file_id, regexp_extract(sql_text, '^\\w+\\s+(\\w+)', 1) as cursor, kind as event_type, line_start as line, func_name from block where kind in ('DECLARE', 'OPEN', 'FETCH', 'CLOSE'))"
_CALLS = """, call as (select distinct file_id, func_name as src, dst, line_no from (select file_id, line_no, """ + _NAME + """ as func_name, unnest(list_distinct(regexp_extract_all(raw, '([A-Za-z_]\\w*)\\s*\\(', 1))) as dst from source_line where raw not like '%EXEC SQL%') c
 where func_name <> dst and exists (select 1 from span s where s.file_id = c.file_id and s.func_name = c.dst))"""


def _files(spark, sf_dir):
    return S.source_files(proc_lines(spark, sf_dir))


def _parsed(spark, sf_dir, files=None):
    """(files, spans, parse, blocks); spans and blocks come out of one parse of a file."""
    files = _files(spark, sf_dir) if files is None else files
    parsed = X.regions(files)
    return files, X.parsed_spans(parsed), parsed, X.sql_blocks(parsed)


@query(f"with {PROC_DUCK} select file_id, line_no, raw from source_line")
def s_source_line(spark, sf_dir):
    """Files joined from lines and split into lines again give the same lines."""
    return S.source_lines(_files(spark, sf_dir))


@query(f"with {_FILES} select file_id, regexp_replace(regexp_replace(content, '/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g') as code from source_file")
def p1_strip_c(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.strip_c(F.col("content")).alias("code"))


@query(f"with {_FILES} select file_id, replace(regexp_replace(regexp_replace(content, '/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), 'UPDATE t SET', 'UPDATE t ' || chr(10) || ' SET') as code from source_file")
def p3_strip_proc(spark, sf_dir):
    """P3, with a comment of SQL put into every UPDATE."""
    content = F.replace(F.col("content"), F.lit("UPDATE t SET"), F.lit("UPDATE t -- it's // new\n SET"))
    return _files(spark, sf_dir).select("file_id", T.strip_proc(content).alias("code"))


@query(f"with {_CODE.join([PROC_DUCK + ', ', ''])} select file_id, line_no, code from code")
def p8_blank_strings(spark, sf_dir):
    return proc_lines(spark, sf_dir).select("file_id", "line_no", T.blank_strings(F.col("raw")).alias("code"))


@query(f"with {PROC_DUCK} select file_id, line_no, case when raw like '%/*%' then split_part(raw, '/*', 1) || repeat(' ', length(raw) - length(split_part(raw, '/*', 1))) when raw like '%//%' then split_part(raw, '//', 1) || repeat(' ', length(raw) - length(split_part(raw, '//', 1))) else raw end as code from source_line")
def p9_blank_comments(spark, sf_dir):
    return proc_lines(spark, sf_dir).select("file_id", "line_no", T.blank_comments(F.col("raw")).alias("code"))


@query(f"with {_FILES} select file_id, regexp_replace(content, 'EXEC SQL [^;]*;', '', 'g') as code from source_file")
def p10_blank_exec_sql(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.blank_embedded_sql(F.col("content")).alias("code"))


@query(f"with {_FILES}, n as (select *, len(string_split(content, chr(10))) as n from source_file) select file_id, length(content) // 3 as tokens, n::bigint as line_count from n")
def p14_token_estimate(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.token_estimate(F.col("content"), 3).alias("tokens"), F.size(T.lines(F.col("content"))).cast("long").alias("line_count"))


@query(f"with {_FILES}, n as (select *, string_split(content, chr(10)) as l from source_file) select file_id, case when len(l) > 20 then array_to_string(l[1:8], chr(10)) || chr(10) || '... ' || (len(l) - 16) || ' lines omitted ...' || chr(10) || array_to_string(l[len(l)-7:], chr(10)) else content end as sample from n")
def p12_head_tail(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.head_tail(F.col("content"), 20, 8, 8).alias("sample"))


@query(f"with {PROC_DUCK} select file_id, line_no, trim(raw) as content, regexp_extract(raw, 'cur_[0-9]') as match, (strpos(raw, regexp_extract(raw, 'cur_[0-9]')) - 1)::bigint as start, (strpos(raw, regexp_extract(raw, 'cur_[0-9]')) + 4)::bigint as \"end\" from source_line where regexp_matches(raw, 'cur_[0-9]')")
def g1_grep(spark, sf_dir):
    return S.grep(proc_lines(spark, sf_dir), "cur_[0-9]")


def _search(table: str, rows: list[tuple[str, str, str, str]]) -> str:
    """(name, condition, match, capture) in the SQL's own words."""
    return " union all ".join(f"select file_id, line_no, '{n}' as pattern, {m} as match, {c} as capture from {table} where {w}" for n, w, m, c in rows)


_cursor = lambda verb: f"regexp_extract(raw, 'EXEC SQL {verb} (cur_[0-9])', 1)"
_PROC_SEARCH = _search("source_line", [
    ("exec_sql", "contains(raw, 'EXEC SQL ')", "'EXEC SQL'", "null::varchar"),
    ("sqlca_check", "contains(raw, 'sqlca.sqlcode')", "'sqlca.sqlcode'", "null"),
    ("cursor_open", "contains(raw, 'EXEC SQL OPEN ')", f"'EXEC SQL OPEN ' || {_cursor('OPEN')}", _cursor("OPEN")),
    ("cursor_close", "contains(raw, 'EXEC SQL CLOSE ')", f"'EXEC SQL CLOSE ' || {_cursor('CLOSE')}", _cursor("CLOSE")),
    ("commit", "contains(raw, 'EXEC SQL COMMIT')", "'EXEC SQL COMMIT'", "null"),
    ("rollback", "contains(raw, 'EXEC SQL ROLLBACK')", "'EXEC SQL ROLLBACK'", "null"),
])


@query(f"with {PROC_DUCK} {_PROC_SEARCH}")
def g2_structural_proc(spark, sf_dir):
    return S.structural_search(proc_lines(spark, sf_dir), "proc")


_C_SEARCH = _search("brace", [
    ("function_def", "starts_with(raw, 'static int fn_')", "raw", "regexp_extract(raw, '(fn_[0-9]+)', 1)"),
    ("malloc", "contains(raw, ' malloc(')", "'malloc('", "null::varchar"),
    ("strcpy", "contains(raw, ' strcpy(') and not contains(raw, 'char buf') or contains(raw, '* strcpy(')", "'strcpy('", "null"),
    ("sprintf", "contains(raw, ' sprintf(')", "'sprintf('", "null"),
])


@query(f"with {PROC_DUCK}, brace as (select file_id, line_no, case when starts_with(raw, 'static') then raw || ' {{' else raw end as raw from source_line) {_C_SEARCH}")
def g2_structural_c(spark, sf_dir):
    """G2, with the brace on the line of the function's name."""
    lines = proc_lines(spark, sf_dir)
    return S.structural_search(lines.withColumn("raw", F.when(F.col("raw").startswith("static"), F.concat("raw", F.lit(" {"))).otherwise(F.col("raw"))), "c")


#: The rules by what the text is made of, not by their patterns.
_RULES = " union all ".join(f"select file_id, line_no, '{r}' as rule_id, '{s}' as severity, '{c}' as category, trim(raw) as raw_match from source_line where {w}" for r, s, c, w in (
    ("UNSAFE_FUNC", "high", "memory_safety", "regexp_matches(raw, '^ +(strcpy|sprintf)\\(')"),
    ("BOUNDED_FUNC", "medium", "memory_safety", "contains(raw, ' memset(')"),
    ("MALLOC_NO_CHECK", "high", "null_safety", "contains(raw, '= malloc(')"),
    ("BUFFER_INDEX", "medium", "memory_safety", "contains(raw, 'buf[ idx ]')"),
    ("FORMAT_STRING", "high", "security", "contains(raw, 'printf(fmt)')"),
))


@query(f"with {PROC_DUCK} {_RULES}")
def c_rules(spark, sf_dir):
    """C2 to C6."""
    return S.scan_rules(proc_lines(spark, sf_dir))


@query(f"with {PROC_DUCK}, {_SPAN}, f as ({_RULES}) select f.*, func_name from f join span s on s.file_id = f.file_id and f.line_no between s.line_start and s.line_end")
def c8_rules_in_functions(spark, sf_dir):
    """Findings with their enclosing function."""
    return S.scan_rules_in_functions(_files(spark, sf_dir))


@query(f"with {PROC_DUCK} select file_id, line_no, 'rec' as variable, 'x' as size_type from source_line where false union all select file_id, line_no, regexp_extract(raw, '& *(\\w+)', 1), regexp_extract(raw, 'sizeof\\((\\w+)\\)', 1) from source_line where raw like '%memset(&%' and regexp_replace(regexp_extract(raw, '& *(\\w+)', 1), '^[lcds]_', '') || '_t' <> regexp_extract(raw, 'sizeof\\((\\w+)\\)', 1)")
def c7_memset_mismatch(spark, sf_dir):
    return S.memset_mismatch(proc_lines(spark, sf_dir))


@query(f"with {PROC_DUCK}, {_SPAN} select file_id, func_name, cursor, string_agg(line_no::varchar, ',' order by line_no) as close_lines from (select distinct file_id, {_NAME} as func_name, regexp_extract(raw, '(?:DBIO_CLOSE\\(|EXEC SQL CLOSE )(\\w+)', 1) as cursor, line_no from source_line where regexp_matches(raw, 'DBIO_CLOSE\\(|EXEC SQL CLOSE ')) group by all having count(*) >= 2")
def c9_duplicate_close(spark, sf_dir):
    lines = proc_lines(spark, sf_dir)
    return E.duplicate_closes(lines, X.function_spans(S.source_files(lines)))


@query(f"with {PROC_DUCK} select file_id, count(*) filter (raw like '%fopen(%') as opened, count(*) filter (raw like '%fclose(%') as closed from source_line group by file_id having opened > closed")
def r4_fclose_missing(spark, sf_dir):
    return S.unclosed_files(proc_lines(spark, sf_dir))


@query(f"with {PROC_DUCK}, {_SPAN} select file_id, func_name, line_start, line_end, line_count, false as is_boilerplate from span")
def x1_function_spans(spark, sf_dir):
    return X.function_spans(_files(spark, sf_dir)).drop("signature")


#: The words before parentheses that the text holds and that are calls.
_CALL = "distinct_call as (select distinct file_id, line_no, unnest(regexp_extract_all(raw, '(fn_[0-9]+|strcpy|strcat|gets|malloc|memset|sprintf|fopen|fclose|printf|DBIO_CLOSE)\\(', 1)) as name from source_line)"


@query(f"with {PROC_DUCK}, {_CALL} select file_id, name, line_no from distinct_call")
def x15_calls(spark, sf_dir):
    return S.calls(proc_lines(spark, sf_dir)).select("file_id", "name", "line_no")


_FACTS = " union all ".join(f"select file_id, line_no, '{n}' as pattern_type from source_line where {w}" for n, w in (("error_handling", "contains(raw, 'WHENEVER SQLERROR') or contains(raw, 'sqlca.sqlcode')"), ("logging", "contains(raw, 'printf(')"), ("memory_management", "contains(raw, 'malloc(')"), ("transaction", "contains(raw, 'SQL COMMIT') or contains(raw, 'SQL ROLLBACK')")))


@query(f"with {PROC_DUCK}, f as ({_FACTS}) select file_id, " + ", ".join(f"count(*) filter (pattern_type = '{n}') as {n}" for n in ("error_handling", "logging", "memory_management", "transaction")) + " from f group by file_id")
def a5_pattern_frequencies(spark, sf_dir):
    """X16 and A5."""
    return S.pattern_frequencies(S.code_patterns(proc_lines(spark, sf_dir), "proc"))


@query(f"with {_BLOCK} select file_id, block_no, kind, sql_text, line_start, line_end, func_name, len(host_vars)::bigint as host_vars, has_sqlca_check, whenever from block")
def x5_sql_blocks(spark, sf_dir):
    """Embedded SQL blocks with the WHENEVER in force."""
    _, _, _, blocks = _parsed(spark, sf_dir)
    return blocks.select("file_id", "block_no", "kind", "sql_text", "line_start", "line_end", "func_name", F.size("host_vars").cast("long").alias("host_vars"), "has_sqlca_check", "whenever")


@query(f"with {_EVENT} select * from event")
def x9_cursor_events(spark, sf_dir):
    return X.cursor_events(_parsed(spark, sf_dir)[3])


@query(f"with {_BLOCK} select file_id, kind, line_start as line, func_name from block where kind in ('COMMIT', 'ROLLBACK', 'SAVEPOINT')")
def x11_transaction_points(spark, sf_dir):
    return X.transaction_points(_parsed(spark, sf_dir)[3])


@query(f"with {_BLOCK} select file_id, 'SQL_SQLCA_MISSING' as rule_id, 'high' as severity, 'data_integrity' as category, line_start as line_no from dml where not has_sqlca_check and whenever is null")
def e1_sqlca_missing(spark, sf_dir):
    return E.sqlca_missing(_parsed(spark, sf_dir)[3])


@query(f"with {_BLOCK}, s as (select *, regexp_extract(sql_text, '^SELECT (.*?) INTO (.*?) FROM', 1) as c, regexp_extract(sql_text, '^SELECT (.*?) INTO (.*?) FROM', 2) as i from block where kind = 'SELECT' and sql_text like '% INTO %') select file_id, 'SQL_SELECT_INTO_MISMATCH' as rule_id, 'high' as severity, 'data_integrity' as category, line_start as line_no from s where len(string_split(c, ',')) <> len(regexp_extract_all(i, ':\\w+'))")
def e2_select_into_mismatch(spark, sf_dir):
    return E.select_into_mismatch(_parsed(spark, sf_dir)[3])


@query(f"with {_BLOCK} select file_id, 'SQL_HOST_VAR_COUNT' as rule_id, 'high' as severity, 'data_integrity' as category, line_start as line_no from block where kind = 'INSERT' and len(string_split(regexp_extract(sql_text, '\\(([^)]*)\\)', 1), ',')) <> len(string_split(regexp_extract(sql_text, 'VALUES \\(([^)]*)\\)', 1), ','))")
def e3_host_var_count(spark, sf_dir):
    return E.host_var_count(_parsed(spark, sf_dir)[3])


@query(f"with {_BLOCK} select file_id, 'SQL_INDICATOR_MISSING' as rule_id, 'medium' as severity, 'null_safety' as category, line_start as line_no from block where kind in ('SELECT', 'FETCH') and len(host_vars) > 0")
def e4_indicator_missing(spark, sf_dir):
    return E.indicator_missing(_parsed(spark, sf_dir)[3])


_LIFE = _EVENT + """, life as (select file_id, cursor, list_sort(list(distinct event_type)) as p, min(line) as first_line from event group by all)"""


@query(f"with {_LIFE} select file_id, cursor, array_to_string(p, ',') as present, array_to_string(list_filter(['DECLARE', 'OPEN', 'FETCH', 'CLOSE'], lambda e: not list_contains(p, e)), ',') as missing, first_line from life")
def x27_cursor_lifecycle(spark, sf_dir):
    """X9, X27 and J14."""
    return E.cursor_lifecycle(X.cursor_events(_parsed(spark, sf_dir)[3]))


_has = lambda e: f"list_contains(p, '{e}')"


@query(f"with {_LIFE} select file_id, cursor, r.rule_id, r.severity, line_no from (select file_id, cursor, first_line as line_no, unnest([{{'rule_id': 'SQL_CURSOR_OPEN_MISSING', 'severity': 'high', 'c': {_has('DECLARE')} and not {_has('OPEN')}}}, {{'rule_id': 'SQL_CURSOR_CLOSE_MISSING', 'severity': 'high', 'c': {_has('OPEN')} and not {_has('CLOSE')}}}, {{'rule_id': 'SQL_CURSOR_FETCH_MISSING', 'severity': 'medium', 'c': {_has('OPEN')} and not {_has('FETCH')}}}, {{'rule_id': 'CROSS_CURSOR_INCOMPLETE', 'severity': 'high', 'c': len(p) < 4}}]) as r from life) where r.c")
def e5_cursor_rules(spark, sf_dir):
    """E5, E6, E7 and K4."""
    return E.cursor_rules(E.cursor_lifecycle(X.cursor_events(_parsed(spark, sf_dir)[3])))


@query(f"with {_BLOCK}, per as (select file_id, min(line_start) filter (kind in ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE')) as dml, min(line_start) filter (kind = 'COMMIT') as c, bool_or(kind in ('COMMIT', 'ROLLBACK', 'SAVEPOINT')) as tx, bool_or(kind = 'ROLLBACK') as rb from block group by file_id) select file_id, 'SQL_COMMIT_MISSING' as rule_id, 'medium' as severity, 'data_integrity' as category, dml as line_no from per where dml is not null and not tx union all select file_id, 'CROSS_TRANSACTION_MISSING_ROLLBACK', 'high', 'data_integrity', c from per where c is not null and not rb")
def e8_file_rules(spark, sf_dir):
    """E8 and K7."""
    return E.file_rules(_parsed(spark, sf_dir)[3])


#: A declare section put before each file: v1 with an indicator, and v2.
_SECTION = ("EXEC SQL BEGIN DECLARE SECTION;", "    int v1;", "    short v1_ind;", "    char v2[20];", "EXEC SQL END DECLARE SECTION;")


def _with_section(spark, sf_dir):
    return _files(spark, sf_dir).withColumn("content", F.concat(F.lit("\n".join(_SECTION) + "\n"), "content"))


@query(f"with {_BLOCK} select file_id, name, min(line_start) + 5 as line_no from (select file_id, line_start, unnest(host_vars) as name from block) where name not in ('v1', 'v2') group by all")
def k1_undeclared_host_vars(spark, sf_dir):
    """K1 and J12, with v1 and v2 declared in a section of every file."""
    return O.undeclared_host_vars(_with_section(spark, sf_dir))


@query(f"with {_BLOCK}, v as (select file_id, name, min(line_start) + 5 as line, min_by(func_name, line_start) as func_name from (select file_id, line_start, func_name, unnest(host_vars) as name from block) where name not in ('v1', 'v2') group by all) select file_id, name, 'unknown' as c_type, line, null::varchar as indicator, func_name from v union all select file_id, d.name, d.c_type, d.line, d.indicator, null from source_file, (values ('v1', 'int', 2::bigint, 'v1_ind'), ('v1_ind', 'short', 3, null), ('v2', 'char[20]', 4, null)) d(name, c_type, line, indicator)")
def x8_host_variables(spark, sf_dir):
    """Declared ones with their indicators, and the others that SQL uses."""
    return O.host_variables(_with_section(spark, sf_dir)).select("file_id", "name", "c_type", "line", "indicator", "func_name")


@query(f"with {_EVENT}, {_SPAN}{_CALLS}, o as (select file_id, cursor, func_name as opener, min(line) as line_no from event where event_type = 'OPEN' group by all), c as (select distinct file_id, cursor, func_name as closer from event where event_type = 'CLOSE') select file_id, cursor, opener, line_no from o where not exists (select 1 from c where c.file_id = o.file_id and c.cursor = o.cursor and c.closer = o.opener) and exists (select 1 from c where c.file_id = o.file_id and c.cursor = o.cursor) and not exists (select 1 from c join call k on k.file_id = c.file_id and k.dst = c.closer where c.file_id = o.file_id and c.cursor = o.cursor and k.src = o.opener)")
def k3_cursor_function_split(spark, sf_dir):
    """K3 and J19."""
    return O.cursor_function_split(_files(spark, sf_dir))


#: Islands of C with the function of their first line; short ones join the one before in the same function.
_SEGMENT = """, island as (select file_id, min(line_no) as a, max(line_no) as b, min_by(ln, line_no) as ln from (select file_id, line_no, ln, line_no - row_number() over (partition by file_id order by line_no) as g from source_line where raw not like '%EXEC SQL%') group by file_id, g),
 opened as (select *, case when b - a + 1 < 5 and lag(ln) over (partition by file_id order by a) = ln then 0 else 1 end as fresh from island),
 seg as (select file_id, min(a) as a, max(b) as b, 'fn_' || min_by(ln, a) as func_name from (select *, sum(fresh) over (partition by file_id order by a) as no from opened) group by file_id, no),
 near as (select b.file_id, b.block_no, b.line_end, b.kind, b.has_sqlca_check, min(seg.a) as segment_start, min_by(seg.b, seg.a) as segment_end from block b left join seg on seg.file_id = b.file_id and seg.func_name = b.func_name and seg.a > b.line_end group by all)"""


@query(f"with {_BLOCK}{_SEGMENT} select file_id, a as line_start, b as line_end, func_name from seg")
def x7_c_segments(spark, sf_dir):
    return X.c_segments(_parsed(spark, sf_dir)[2]).drop("error_path")


@query(f"with {_BLOCK}{_SEGMENT} select file_id, block_no, segment_start, segment_end from near")
def j9_next_segment(spark, sf_dir):
    """The next C segment of the same function after each block."""
    _, _, parsed, blocks = _parsed(spark, sf_dir)
    return E.next_segment(blocks, X.c_segments(parsed)).drop("error_path")


@query(f"with {_BLOCK}{_SEGMENT} select n.file_id, 'CROSS_SQLCA_NO_ERROR_PATH' as rule_id, 'medium' as severity, 'data_integrity' as category, n.line_end as line_no, n.segment_end as line_end from near n where kind in ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE') and has_sqlca_check and segment_start is not null and not exists (select 1 from source_line s where s.file_id = n.file_id and s.line_no between n.segment_start and n.segment_end and (contains(s.raw, 'return -1;') or contains(s.raw, 'GOTO err')))")
def k5_no_error_path(spark, sf_dir):
    _, _, parsed, blocks = _parsed(spark, sf_dir)
    return E.no_error_path(blocks, X.c_segments(parsed))


@query(f"with {_BLOCK}, {_SPAN}{_CALLS}, d as (select file_id, func_name, min(line_start) as line_no from dml group by all), t as (select distinct file_id, func_name from block where kind in ('COMMIT', 'ROLLBACK')), l as (select file_id, src as f, dst as o from call union select file_id, dst, src from call) select file_id, func_name, line_no from d where file_id in (select file_id from t) and file_id in (select file_id from call) and not exists (select 1 from t where t.file_id = d.file_id and t.func_name = d.func_name) and not exists (select 1 from l join t on t.file_id = l.file_id and t.func_name = l.o where l.file_id = d.file_id and l.f = d.func_name)")
def k6_transaction_split(spark, sf_dir):
    return O.transaction_split(_files(spark, sf_dir))


@query(f"with {PROC_DUCK}, {_SPAN}{_CALLS} select file_id, src, dst, line_no from call")
def h5_call_edges(spark, sf_dir):
    lines = proc_lines(spark, sf_dir)
    return E.call_edges(lines, X.function_spans(S.source_files(lines)))


@query(f"""with {_BLOCK}, {_SPAN}{_CALLS}, e as (
 select file_id, 'func:' || func_name as src, 'sql:' || block_no as dst, 'CONTAINS' as edge_type from block
 union all select file_id, 'sql:' || block_no, 'hvar:' || unnest(host_vars), 'USES_HOST_VAR' from block
 union all select file_id, 'sql:' || block_no, 'cursor:' || regexp_extract(sql_text, '^\\w+\\s+(\\w+)', 1), kind || '_CURSOR' from block where kind in ('DECLARE', 'OPEN', 'FETCH', 'CLOSE')
 union all select file_id, 'func:' || func_name, 'tx:' || kind, 'HAS_TRANSACTION' from block where kind in ('COMMIT', 'ROLLBACK', 'SAVEPOINT')
 union all select file_id, 'sql:' || block_no, 'sql:' || block_no, 'CHECKS_ERROR' from block where has_sqlca_check
 union all select file_id, 'hvar:' || name, 'func:' || func_name, 'DECLARED_IN' from (select file_id, name, min_by(func_name, line_start) as func_name from (select file_id, line_start, func_name, unnest(host_vars) as name from block) group by all)
 union all select file_id, 'func:' || src, 'func:' || dst, 'CALLS' from call)
 select file_id, src, dst, edge_type, count(*) as n from e group by all""")
def h4_symbol_graph(spark, sf_dir):
    return O.symbol_graph(_files(spark, sf_dir))


@query(f"with {PROC_DUCK}, {_SPAN}{_CALLS} select file_id, 'func:' || src as src, 'func:fn_1' as dst, 'CALLS' as edge_type, count(*) as n from call where dst = 'fn_1' group by all")
def h6_callers(spark, sf_dir):
    """H6: what calls fn_1."""
    return E.adjacent(O.symbol_graph(_files(spark, sf_dir), "CALLS"), "func:fn_1", outgoing=False, edge_type="CALLS")


@query(f"with {PROC_DUCK}, {_SPAN}, f as ({_RULES}), g as (select file_id, func_name, fn % 2 as group_no, line_start, line_end from span), r as (select f.*, case when line_no % 5 = 0 then 'fn_1' end as func_name from f) select distinct r.*, g.group_no from r join g on g.file_id = r.file_id and (r.line_no between g.line_start and g.line_end or r.func_name = g.func_name)")
def j6_in_group(spark, sf_dir):
    """Findings in a group of functions by line or by the function's name, which every fifth line claims is fn_1."""
    files = _files(spark, sf_dir)
    spans = X.function_spans(files)
    groups = spans.select("file_id", ((F.regexp_extract("func_name", r"(\d+)$", 1).cast("long") - 1) % 2).alias("group_no"), "func_name")
    found = S.scan_rules(proc_lines(spark, sf_dir)).withColumn("func_name", F.when(F.col("line_no") % 5 == 0, F.lit("fn_1")))
    return E.in_group(found, spans, groups)


@query(f"with {_BLOCK}, {_SPAN}{_CALLS}{_SEGMENT}, ev as (select file_id, regexp_extract(sql_text, '^\\w+\\s+(\\w+)', 1) as cursor, kind as event_type, line_start as line, func_name from block where kind in ('DECLARE', 'OPEN', 'FETCH', 'CLOSE')), o as (select file_id, cursor, func_name as opener, min(line) as line_no from ev where event_type = 'OPEN' group by all), c as (select distinct file_id, cursor, func_name as closer from ev where event_type = 'CLOSE'), d as (select file_id, func_name, min(line_start) as line_no from dml group by all), t as (select distinct file_id, func_name from block where kind in ('COMMIT', 'ROLLBACK')), l as (select file_id, src as f, dst as o from call union select file_id, dst, src from call) "
    "select file_id, 'CROSS_HOST_VAR_UNDECLARED' as rule_id, 'critical' as severity, min(line_start) as line_no from (select file_id, line_start, unnest(host_vars) as name from block) group by file_id, name "
    "union all select file_id, 'CROSS_CURSOR_FUNC_SPLIT', 'high', line_no from o where not exists (select 1 from c where c.file_id = o.file_id and c.cursor = o.cursor and c.closer = o.opener) and exists (select 1 from c where c.file_id = o.file_id and c.cursor = o.cursor) and not exists (select 1 from c join call k on k.file_id = c.file_id and k.dst = c.closer where c.file_id = o.file_id and c.cursor = o.cursor and k.src = o.opener) "
    "union all select file_id, 'CROSS_CURSOR_INCOMPLETE', 'high', min(line) from ev group by file_id, cursor having count(distinct event_type) < 4 "
    "union all select n.file_id, 'CROSS_SQLCA_NO_ERROR_PATH', 'medium', n.line_end from near n where kind in ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE') and has_sqlca_check and segment_start is not null and not exists (select 1 from source_line s where s.file_id = n.file_id and s.line_no between n.segment_start and n.segment_end and (contains(s.raw, 'return -1;') or contains(s.raw, 'GOTO err'))) "
    "union all select file_id, 'CROSS_TRANSACTION_SPLIT', 'medium', line_no from d where file_id in (select file_id from t) and file_id in (select file_id from call) and not exists (select 1 from t where t.file_id = d.file_id and t.func_name = d.func_name) and not exists (select 1 from l join t on t.file_id = l.file_id and t.func_name = l.o where l.file_id = d.file_id and l.f = d.func_name) "
    "union all select file_id, 'CROSS_TRANSACTION_MISSING_ROLLBACK', 'high', min(line_start) filter (kind = 'COMMIT') from block group by file_id having bool_or(kind = 'COMMIT') and not bool_or(kind = 'ROLLBACK')")
def k0_cross_checks(spark, sf_dir):
    """K0 to K7 together."""
    return O.cross_checks(_files(spark, sf_dir))


@query(f"with recursive {PROC_DUCK}, {_SPAN}, p as (select file_id, fn, func_name, line_count as total, 0::bigint as group_no from span where fn = 0 union all select s.file_id, s.fn, s.func_name, case when p.total + s.line_count > 24 then s.line_count else p.total + s.line_count end, p.group_no + case when p.total + s.line_count > 24 then 1 else 0 end from p join span s on s.file_id = p.file_id and s.fn = p.fn + 1) select file_id, func_name, group_no from p")
def x30_pack_lines(spark, sf_dir):
    return X.pack_lines(X.function_spans(_files(spark, sf_dir)), 24)


@query(f"with {_FILES}, {_SPAN}, n as (select file_id, list_sort(list(line_count)) as l from span group by file_id) select file_id, length(content) // 3 as tokens, l[-1] as longest, l[len(l) // 2 + 1] as median, case when len(l) >= 2 and l[-1] / l[len(l) // 2 + 1] > 1.12 then 'per_function' else 'single' end as route from n join source_file using (file_id)")
def a13_routing(spark, sf_dir):
    """A13, with a ratio that functions of eight to ten lines can pass."""
    from ..operators import issues as I

    files = _files(spark, sf_dir)
    return I.routing(files, X.function_spans(files), 1.12)


@query(f"with {PROC_DUCK}, {_SPAN} select file_id, func_name, line_start + fn as line_start, line_end + fn + 1 as line_end, 'static int ' || func_name || '(int a, char *src)' as signature from span")
def x2_two_line_names(spark, sf_dir):
    """X2, with each function's type on a line of its own."""
    content = F.replace(F.col("content"), F.lit("static int fn_"), F.lit("static int\nfn_"))
    return X.function_spans(_files(spark, sf_dir).withColumn("content", content)).select("file_id", "func_name", "line_start", "line_end", "signature")


_ALL = " union all ".join(f"select file_id, rule_id, severity, line_no from ({ORACLES[q]})" for q in ("e1_sqlca_missing", "e2_select_into_mismatch", "e3_host_var_count", "e4_indicator_missing", "e8_file_rules", "e5_cursor_rules", "c_rules"))


@query(_ALL)
def w18_findings(spark, sf_dir):
    """The findings of all scanners as one relation."""
    return verdict.embedded_sql_findings(_files(spark, sf_dir))
