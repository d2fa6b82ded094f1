"""Queries on the context of files, over the source text made from lineitem and small tables of paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import embedded_sql as E
from ..operators import one_pass as O
from ..operators import search as S
from ..operators import structure as X
from ..sources import tool_output as TO
from ..sources.files import include_closure
from ._base import PROC_DUCK, proc_lines, query, table
from .issues import _DUCK as _ISSUE
from .issues import _issues
from .source import _BLOCK, _CALL, _EVENT, _FILES, _RULES, _SPAN, _files, _parsed


def _spans(spark, sf_dir):
    return X.function_spans(_files(spark, sf_dir))


@query(f"""with {_FILES}, s as (select file_id, case file_id % 5 when 4 then content || '<!-- 1-2 -->' else content || '"1-2"' end as content from source_file), c as (select file_id, content, case file_id % 5 when 3 then content when 4 then replace(content, '<!-- 1-2 -->', '') else replace(regexp_replace(regexp_replace(content, '/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '"1-2"', '"1*2"') end as code from s)
 select file_id, case file_id % 5 when 0 then 'proc' when 1 then 'javascript' when 2 then 'c' when 3 then 'other' else 'xml' end as language, code, (length(content) - length(code))::bigint as removed, true as lines_kept from c""")
def p7_strip_corpus(spark, sf_dir):
    """A literal with a hyphen, or a comment of markup, ends each file."""
    k = F.col("file_id") % 5
    language = F.when(k == 0, "proc").when(k == 1, "javascript").when(k == 2, "c").when(k == 3, "other").otherwise("xml")
    content = F.concat("content", F.when(k == 4, "<!-- 1-2 -->").otherwise('"1-2"'))
    return C.strip_corpus(_files(spark, sf_dir).withColumns({"language": language, "content": content}))


@query(f"with {_FILES}, n as (select *, string_split(content, chr(10)) as l from source_file) select file_id, case when len(l) > 20 then array_to_string(l[1:8], chr(10)) || chr(10) || 'summary' || chr(10) || array_to_string(l[len(l)-3:], chr(10)) else content end as content from n")
def p13_optimise(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", C.optimise(F.col("content"), F.lit("summary"), 20, 8, 4).alias("content"))


#: Statements put after each file: cursors of statements that are prepared from a literal, from a buffer that two lines
#: fill, and from one that no line fills.
_PREPARED = (
    "EXEC SQL PREPARE p1 FROM \"SELECT 1 FROM a\";",
    "EXEC SQL DECLARE c1 CURSOR FOR p1;",
    "snprintf((char *)q.arr, 10, \"SELECT x \"",
    "  \"FROM \\\"b\\\" WHERE y = %d\", n);",
    "EXEC SQL PREPARE p2 FROM :q;",
    "EXEC SQL DECLARE c2 CURSOR FOR p2;",
    "strcpy(w, \"UPDATE z\");",
    "EXEC SQL PREPARE p3 FROM :w;",
    "EXEC SQL DECLARE c3 CURSOR FOR p3;",
)


@query(f"with {_BLOCK} select file_id, regexp_extract(sql_text, '^DECLARE (\\w+)', 1) as cursor, regexp_extract(sql_text, 'FOR (SELECT.*)$', 1) as body from block where kind = 'DECLARE' union all select file_id, c.cursor, c.body from source_file, (values ('c1', 'SELECT 1 FROM a'), ('c2', 'SELECT x FROM \"b\" WHERE y = %d'), ('c3', null)) c(cursor, body)")
def x10_cursor_bodies(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n" + "\n".join(_PREPARED))))
    return O.cursor_bodies(files)


#: An include, a macro and a variable before the first line.
_HEADS = ("#include <stdio.h>", "#define N 3", "static int total = 0;")


def _with_heads(lines):
    heads = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(t).alias("t")) for n, t in enumerate(_HEADS, -2)])
    return lines.union(lines.select("file_id").distinct().select("file_id", F.explode(heads).alias("h")).select("file_id", F.col("h.n").alias("line_no"), F.col("h.t").alias("raw")))


@query(f"with {PROC_DUCK} select distinct file_id, l.line_no, l.kind, l.text from source_line, (values (-2::bigint, 'include', '#include <stdio.h>'), (-1, 'macro', '#define N 3'), (0, 'global', 'static int total = 0;')) l(line_no, kind, text)")
def x12_global_context(spark, sf_dir):
    return C.global_context(_with_heads(proc_lines(spark, sf_dir)), _spans(spark, sf_dir))


@query(f"with {PROC_DUCK} select file_id, line_no, regexp_extract(raw, 'EXEC SQL ([^;]*);', 1) as sql_text from source_line where raw like '%EXEC SQL %' and not regexp_matches(raw, 'EXEC SQL (WHENEVER|DECLARE)')")
def x13_exec_sql(spark, sf_dir):
    return C.exec_sql_statements(_files(spark, sf_dir))


@query("select p_partkey as file_id, 1::bigint as line_no, case p_size % 4 when 0 then 'stdio.h' when 1 then 'util' || p_size || '.h' when 2 then 'sqlca' else './lib' || p_size end as target, p_size % 4 in (0, 2) as external from part")
def x14_imports(spark, sf_dir):
    n = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 == 0, F.lit("#include <stdio.h>")).when(F.col("p_size") % 4 == 1, F.concat(F.lit('#include "util'), n, F.lit('.h"'))).when(F.col("p_size") % 4 == 2, F.lit("EXEC SQL INCLUDE sqlca;")).otherwise(F.concat(F.lit("import x from './lib"), n, F.lit("'")))
    return S.imports(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.lit(1).cast("long").alias("line_no"), raw.alias("raw")))


@query(f"with {PROC_DUCK}, {_SPAN} select file_id, string_agg('[L' || line_start || '~L' || line_end || '] static int ' || func_name || '(int a, char *src) - ' || line_count || ' lines', chr(10) order by line_start) as summary from span group by file_id")
def x24_function_summary(spark, sf_dir):
    return C.function_summary(_spans(spark, sf_dir))


@query(f"with {PROC_DUCK}, {_SPAN}, {_CALL}, c as (select distinct file_id, name from distinct_call), d as (select file_id, count(*) as n, list_sort(list(name)) as l from c group by file_id), f as (select file_id, count(*) as n, list_sort(list(func_name)) as l, string_agg('static int ' || func_name || '(int a, char *src)', chr(10) order by line_start) filter (fn < 30) as s from span group by file_id) select file_id, f.n as n_functions, d.n as n_calls, 0::bigint as n_imports, array_to_string(f.l[1:20], ', ') as functions, array_to_string(d.l[1:20], ', ') as calls, '' as imports, f.s as signatures, 'static int total = 0;' as globals from f join d using (file_id)")
def x23_structure_summary(spark, sf_dir):
    return O.structure_summary(_files(spark, sf_dir), _HEADS)


@query(f"with {PROC_DUCK}, {_SPAN} select distinct file_id, line_start, line_end from source_line join span using (file_id) where raw like '%gets(y)%' and line_no between line_start and line_end")
def x25_around_errors(spark, sf_dir):
    return C.around_errors(proc_lines(spark, sf_dir).where("raw like '%gets(y)%'"), _spans(spark, sf_dir))


@query("with l as (select o_orderkey as file_id, unnest([1, 2, 3, 4]) as line_no from orders) select file_id, 1::bigint as line_start, case file_id % 2 when 0 then 2 else 3 end::bigint as line_end from (select distinct file_id from l) union all select file_id, case file_id % 2 when 0 then 3 else 4 end::bigint, 4::bigint from (select distinct file_id from l)")
def x26_statement_spans(spark, sf_dir):
    even = F.col("o_orderkey") % 2 == 0
    text = F.when(even, "SELECT a\nFROM t;\nUPDATE t\nSET a = 1;").otherwise("SELECT a\nFROM t\nWHERE b = 1;\nDELETE FROM t")
    return C.statement_spans(S.source_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), text.alias("content"))))


@query(f"with {PROC_DUCK}, {_SPAN}, n as (select file_id, line_start, fn, case fn % 6 when 0 then 'z' || (10 + fn) || '_' || func_name when 1 then 'rep_' || func_name when 2 then 'B10_' || func_name when 3 then func_name || '_init_proc' else func_name end as func_name, case fn % 6 when 0 then 'z' when 1 then 'rep' end as g from span) select file_id, func_name, line_start, case when fn % 6 = 3 then 'boilerplate' when g is not null and count(*) over (partition by file_id, g) > 1 then 'utility' else 'dispatch' end as function_class from n")
def x29_function_classes(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    fn = F.regexp_extract("func_name", r"(\d+)$", 1).cast("int") - 1
    name = F.when(fn % 6 == 0, F.concat(F.lit("z"), (fn + 10).cast("string"), F.lit("_"), "func_name")).when(fn % 6 == 1, F.concat(F.lit("rep_"), "func_name")).when(fn % 6 == 2, F.concat(F.lit("B10_"), "func_name")).when(fn % 6 == 3, F.concat("func_name", F.lit("_init_proc"))).otherwise(F.col("func_name"))
    return C.function_classes(spans.withColumn("func_name", name))


@query(f"with {PROC_DUCK}, f as ({_RULES}) select rule_id, count(*) as n, count(distinct file_id) as files from f group by rule_id")
def a7_rule_counts(spark, sf_dir):
    return C.rule_counts(S.scan_rules(proc_lines(spark, sf_dir)))


@query(f"with {PROC_DUCK}, {_SPAN} select file_id, count(*) as functions, avg(line_count) as mean_lines, min(line_count) as least, max(line_count) as greatest from span group by file_id")
def a12_group_stats(spark, sf_dir):
    return C.group_stats(_spans(spark, sf_dir))


@query(f"with {PROC_DUCK}, m as (select file_id, line_no, regexp_extract(raw, '& *(\\w+)', 1) as variable, regexp_extract(raw, 'sizeof\\((\\w+)\\)', 1) as size_type from source_line where raw like '%memset(&%') select file_id, line_no, variable, size_type, null::varchar as declared_type from m where variable = 'l_rec' and size_type = 'row_t'")
def r2_memset_declared(spark, sf_dir):
    return C.memset_declared(proc_lines(spark, sf_dir))


@query("select p_partkey as file_id, 1::bigint as line_no, 'FORMAT_STRUCT' as rule_id, 'critical' as severity from part where p_size % 3 = 0")
def r1_struct_formats(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, 'printf("%s", a.b[i]);').when(F.col("p_size") % 3 == 1, 'printf("%s", a.b[i].c);').otherwise('printf("%d", a.b[i]);')
    return C.struct_formats(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.lit(1).cast("long").alias("line_no"), raw.alias("raw")))


@query("select p_partkey as file_id, 2::bigint as line_no, 'rec' as variable from part where p_size % 2 = 0")
def r3_loop_init_missing(spark, sf_dir):
    body = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("  memset(&rec, 0, 4);\n"))
    content = F.concat(F.lit("int f() {\nwhile (next(x)) {\n"), body, F.lit("  strncpy(rec.name, s, 3);\n  for (i = 0; i < 2; i++) {\n  }\n}\n}"))
    return C.loop_init_missing(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), content.alias("content")))


@query(f"with {PROC_DUCK}, g as (select file_id, line_no as a from source_line where raw like '%gets(y)%') select g.file_id, g.a as line_no, string_agg(case when s.line_no = g.a then '>' else ' ' end || s.line_no || ': ' || s.raw, chr(10) order by s.line_no) as snippet from g join source_line s on s.file_id = g.file_id and s.line_no between g.a - 5 and g.a + 5 group by all")
def w15_snippets(spark, sf_dir):
    lines = proc_lines(spark, sf_dir)
    return C.snippets(lines.where("raw like '%gets(y)%'"), lines)


@query(f"with {_BLOCK}, t as (select distinct file_id, func_name from block where kind = 'COMMIT'), u as (select distinct file_id, unnest(host_vars) as name from block semi join t using (file_id, func_name)) select file_id, array_to_string(list_sort(list(name))[1:20], ',') as variables from u group by file_id")
def w16_related_variables(spark, sf_dir):
    _, _, _, blocks = _parsed(spark, sf_dir)
    return C.related_variables(blocks, X.transaction_points(blocks).where("kind = 'COMMIT'"))

@query(f"with {_EVENT}, t as (select distinct file_id, func_name from block where kind = 'COMMIT'), o as (select distinct file_id, cursor from event semi join t using (file_id, func_name)), g as (select file_id, cursor, string_agg(event_type || '(L' || line || ', ' || func_name || ')', ' → ' order by line) as events, list(distinct event_type) as p from event semi join o using (file_id, cursor) group by all), d as (select distinct file_id, regexp_extract(sql_text, '^DECLARE (\\w+)', 1) as cursor from block where kind = 'DECLARE') select file_id, g.cursor, events, array_to_string(list_filter(['DECLARE', 'OPEN', 'FETCH', 'CLOSE'], lambda e: not list_contains(p, e)), ',') as missing, case when d.cursor is not null then 'SELECT a F' end as body from g left join d using (file_id, cursor)")
def w16_related_cursors(spark, sf_dir):
    """W16, with bodies cut at ten characters."""
    return O.related_cursors(_files(spark, sf_dir), most=10)


@query(f"with {_ISSUE}, s as (select distinct file_id from issue), x as (select distinct file_id from issue where severity = 'critical') select file_id, case when file_id in (select file_id from x) then 'error_focused' else 'whole' end as route from s")
def w22_routes(spark, sf_dir):
    rows = _issues(spark, sf_dir)
    return C.routes(rows.where("severity = 'critical'"), rows.select("file_id").distinct())


@query("select o_custkey as file_id, o_orderpriority as name, 1::bigint as line_no, min(case when o_orderkey % 2 = 0 then o_orderstatus end) as target from orders group by all")
def j2_merge_contexts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderstatus").alias("target"))
    every = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("name"), F.lit(1).cast("long").alias("line_no"), F.lit(None).cast("string").alias("target"))
    return C.merge_contexts(every, o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("name"), F.lit(1).cast("long").alias("line_no"), "target"))


@query("with t as (select c_name as path, c_nationkey as group_id, case when c_custkey % 5 = 0 then 0 else c_custkey % 3 + 1 end::bigint as priority from customer) select path, group_id, priority, row_number() over (partition by group_id order by priority, path) as position from t")
def j3_override_priorities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tasks = c.select(F.col("c_name").alias("path"), F.col("c_nationkey").alias("group_id"), (F.col("c_custkey") % 3 + 1).alias("priority"))
    return C.override_priorities(tasks, c.where("c_custkey % 5 = 0").select(F.col("c_name").alias("path"), F.lit(0).cast("long").alias("priority")))


@query("with f as (select p_partkey, 'src' || p_partkey % 3 || '/f' || p_partkey || '.c' as path from part) select a.p_partkey as file_id, a.path, case a.p_partkey % 2 when 0 then './f' || (a.p_partkey + 3) else 'inc/f' || (a.p_partkey + 1) || '.c' end as target, b.path as resolved from f a join f b on b.p_partkey = a.p_partkey + case a.p_partkey % 2 when 0 then 3 else 1 end")
def j18_resolve_references(spark, sf_dir):
    """By the path beside the file without its extension, or by name."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(key, F.concat(F.lit("src"), (key % 3).cast("string"), F.lit("/f"), key.cast("string"), F.lit(".c")).alias("path"))
    target = F.when(key % 2 == 0, F.concat(F.lit("./f"), (key + 3).cast("string"))).otherwise(F.concat(F.lit("inc/f"), (key + 1).cast("string"), F.lit(".c")))
    return C.resolve_references(part.select(key.alias("file_id"), "path", target.alias("target")), part.select("path"))


@query("with recursive i as (select 'h' || p_partkey as file, 'h' || (p_partkey // 2) as header from part where p_partkey > 1), r as (select file, header, 1 as level from i union all select r.file, i.header, r.level + 1 from r join i on i.file = r.header where r.level < 3) select * from r")
def s13_include_closure(spark, sf_dir):
    key = F.col("p_partkey")
    inc = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.concat(F.lit("h"), key.cast("string")).alias("file"), F.concat(F.lit("h"), F.floor(key / 2).cast("string")).alias("header"))
    return include_closure(inc)


@query("select 'f' || p_partkey || '.c' as path, p_size::bigint as line_no, 2::bigint as column_no, case p_size % 3 when 0 then 'error' else 'warning' end as level, 'text' as message, case p_size % 2 when 0 then 'bugprone-x' else 'misc-y' end as \"check\", case when p_size % 2 = 0 or p_size % 3 = 0 then 'high' else 'medium' end as severity from part where p_size % 5 <> 0")
def s10_clang_tidy(spark, sf_dir):
    """Diagnostics printed and read again; every fifth is a missing header."""
    size = F.col("p_size")
    raw = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".c:"), size.cast("string"), F.lit(":2: "), F.when(size % 3 == 0, "error").otherwise("warning"), F.lit(": "), F.when(size % 5 == 0, "'a.h' file not found").otherwise("text"), F.lit(" ["), F.when(size % 2 == 0, "bugprone-x").otherwise("misc-y"), F.lit("]"))
    return TO.clang_tidy(table(spark, sf_dir, "part").select(raw.alias("raw")))


@query("select 'f' || p_partkey as path, p_size::bigint as line_no, case p_size % 2 when 0 then p_size + 1 else p_size end::bigint as line_end, 'no-var' as rule, case p_size % 3 when 2 then 'error' else 'warning' end as level, 'm' as message from part where p_size % 3 <> 0")
def s9_eslint(spark, sf_dir):
    item = F.struct(F.lit("no-var").alias("ruleId"), (F.col("p_size") % 3).alias("severity"), F.lit("m").alias("message"), F.col("p_size").alias("line"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).alias("endLine"))
    doc = F.to_json(F.array(F.struct(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("filePath"), F.array(item).alias("messages"))))
    return TO.eslint(table(spark, sf_dir, "part").select(doc.alias("json")))


@query("select conv_id as response_id, string_agg(turn || ';', '' order by turn) as text, null::varchar as error from (select distinct conv_id, turn from conversations) group by conv_id")
def s14_response_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return TO.response_text(rows.select(F.col("conv_id").alias("response_id"), F.col("turn").alias("seq"), F.to_json(F.struct(F.concat(F.col("turn").cast("string"), F.lit(";")).alias("token"))).alias("raw")))


@query("with t as (select p_partkey as file_id, p_size, p_size % 2 as k, case p_size % 6 when 0 then 'int' when 1 then 'char[20]' when 2 then 'VARCHAR' when 3 then 'unsigned long *' when 4 then 'double' else 'char' end as c_type from part) select file_id, 'v1' as name, case k when 0 then 'NUMBER' else 'VARCHAR' end as context, c_type, 1::bigint as line_no from t where p_size % 7 <> 0 and (k = 0 and c_type in ('char[20]', 'char') or k = 1 and c_type in ('int', 'unsigned long *', 'double'))")
def k2_type_mismatches(spark, sf_dir):
    """K2: six types; every seventh statement isn't one that is looked at."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    sql = F.concat(F.lit("SELECT "), F.when(size % 2 == 0, "TO_NUMBER").otherwise("to_char"), F.lit(" (x || :v1) INTO :v2 FROM t"))
    blocks = part.select(F.col("p_partkey").alias("file_id"), F.when(size % 7 == 0, "DELETE").otherwise("SELECT").alias("kind"), sql.alias("sql_text"), F.array(F.lit("v1"), F.lit("v2")).alias("host_vars"), F.lit(1).cast("long").alias("line_start"))
    kind = F.when(size % 6 == 0, "int").when(size % 6 == 1, "char[20]").when(size % 6 == 2, "VARCHAR").when(size % 6 == 3, "unsigned long *").when(size % 6 == 4, "double").otherwise("char")
    return E.type_mismatches(blocks, part.select(F.col("p_partkey").alias("file_id"), F.lit("v1").alias("name"), kind.alias("c_type")))


@query("with t as (select p_partkey as file_id, p_size::bigint as size, p_size % 3 as k from part) select file_id, size as line, 3::bigint as \"column\", case k when 2 then null else 'PCC-S-0220' || k end as code, 'Semantic error at line ' || size || ', column 3' as message from t union all select file_id, 12, 0, 'PCC-S-02201', 'bad' from t where k = 1")
def s11_precompiler(spark, sf_dir):
    """A code, unless the size leaves 2 by 3, then a position; some codes say what is wrong themselves."""
    size = F.col("p_size")
    code = F.when(size % 3 == 2, "nothing").when(size % 3 == 1, " PCC-S-02201, f.pc(12): bad ").otherwise("PCC-S-02200, bad")
    at = F.concat(F.lit("Semantic error at line "), size.cast("string"), F.lit(", column 3"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.posexplode(F.array(code, at)).alias("line_no", "raw"))
    return TO.precompiler(rows)


@query("with f as (select 'd' || p_size % 5 || '/' || p_brand || '.c' as path from part), l as (select distinct path from f), n as (select distinct p_brand || '.c' as name from part union select 'none.c') select name, case when count(path) = 1 then min(path) end as path, case when count(path) = 0 then 'missing' when count(path) > 1 then 'ambiguous' end as error from n left join l on ends_with(path, '/' || name) group by name")
def s5_resolve_inputs(spark, sf_dir):
    from ..sources.files import resolve_inputs

    part = table(spark, sf_dir, "part")
    listing = part.select(F.concat(F.lit("d"), (F.col("p_size") % 5).cast("string"), F.lit("/"), "p_brand", F.lit(".c")).alias("path")).distinct()
    names = part.select(F.concat("p_brand", F.lit(".c")).alias("name")).union(spark.createDataFrame([("none.c",)], "name string")).distinct()
    return resolve_inputs(names, listing)


@query("with r as (select p_partkey as seq, 'f' || p_size || case p_size % 3 when 0 then '.c' when 1 then '.txt' else '.sql' end as path, p_size from part qualify row_number() over (partition by p_size order by p_partkey) = 1) select seq, path, case p_size % 3 when 0 then 'c' when 2 then 'sql' end as language, case when p_size % 4 = 1 then 'missing' when p_size % 4 = 2 then 'not a file' when p_size % 4 = 3 and p_size % 8 = 3 then 'not readable' when p_size % 3 = 1 then 'unsupported extension' end as reason from r")
def s6_validate(spark, sf_dir):
    from ..sources.files import validate

    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    path = F.concat(F.lit("f"), size.cast("string"), F.when(size % 3 == 0, ".c").when(size % 3 == 1, ".txt").otherwise(".sql"))
    listing = part.where(size % 4 != 1).select(path.alias("path"), (size % 4 != 2).alias("is_file"), (size % 8 != 3).alias("readable")).distinct()
    return validate(part.select(F.col("p_partkey").alias("seq"), path.alias("path")), listing)


@query("select p_partkey as doc_id, 'f' || p_partkey || '.' || lower(p_brand) as path, null::varchar as language from part where false union all select p_partkey, 'f' || p_partkey || case p_size % 4 when 0 then '.JS' when 1 then '.h' when 2 then '.pc' else '.md' end, case p_size % 4 when 0 then 'javascript' when 1 then 'c' when 2 then 'proc' end from part")
def s7_language(spark, sf_dir):
    from ..sources.files import with_language

    size = F.col("p_size")
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(size % 4 == 0, ".JS").when(size % 4 == 1, ".h").when(size % 4 == 2, ".pc").otherwise(".md"))
    return with_language(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), path.alias("path")))


@query("with f as (select p_partkey, 'src/' || case p_size % 3 when 0 then './' when 1 then 'x/../' else '' end || 'f' || p_partkey || '.c' as raw, '/r/src/f' || p_partkey || '.c' as whole from part) select case p_partkey % 2 when 0 then raw else whole end as path, p_partkey as note from f")
def j1_contexts(spark, sf_dir):
    """Contexts by the path as it is written, and by the path that it means."""
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = F.concat(F.lit("src/"), F.when(size % 3 == 0, "./").when(size % 3 == 1, "x/../").otherwise(""), F.lit("f"), key.cast("string"), F.lit(".c"))
    part = table(spark, sf_dir, "part").select(key, raw.alias("raw"))
    files = part.select(F.when(key % 2 == 0, F.col("raw")).otherwise(F.concat(F.lit("/r/src/f"), key.cast("string"), F.lit(".c"))).alias("path"))
    return C.with_contexts(files, part.select(F.col("raw").alias("path"), key.alias("seq"), key.alias("note")), "/r")


@query("with recursive r as (select p_partkey as k, p_partkey % 64 as i, 0 as level from part union all select k, i // 2, level + 1 from r where i % 5 <> 0 and i > 1 and level < 3) select 'r/s' || k % 3 || '/x/f' || k || '.c' as source, 'h' || i || '.h' as header, case when i % 5 <> 0 then 'real' else 'unresolved' end as kind, case when i % 5 <> 0 then 'r/h' || i || '.h' end as resolved, level from r union all select 'r/s' || p_partkey % 3 || '/x/f' || p_partkey || '.c', 'stdio.h', 'system', null, 0 from part")
def s13_headers(spark, sf_dir):
    """Headers two folders above the sources, each of which includes that of half its number; every fifth isn't there."""
    from ..sources.files import resolve_headers

    key = F.col("p_partkey")
    source = F.concat(F.lit("r/s"), (key % 3).cast("string"), F.lit("/x/f"), key.cast("string"), F.lit(".c"))
    name = lambda i: F.concat(F.lit("h"), i.cast("string"), F.lit(".h"))
    own = table(spark, sf_dir, "part").select(source.alias("path"), F.inline(F.array(F.struct(name(key % 64).alias("header"), F.lit(False).alias("is_system")), F.struct(F.lit("stdio.h").alias("header"), F.lit(True).alias("is_system")))))
    headers = spark.range(64).where("id % 5 <> 0")
    of = lambda i: F.concat(F.lit("r/"), name(i))
    inner = headers.where("id > 1").select(of(F.col("id")).alias("path"), name(F.floor(F.col("id") / 2)).alias("header"), F.lit(False).alias("is_system"))
    return resolve_headers(own.select("path"), own.union(inner), headers.select(of(F.col("id")).alias("path")).union(own.select("path").distinct()))
