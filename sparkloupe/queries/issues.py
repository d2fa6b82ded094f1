"""Queries on issues, which are made from events: filters, deduplication, ranking, aggregation, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import issues as I
from ..operators import report as R
from ._base import query, table

_SQL = """select cast(user_id % 300 as bigint) as file_id, event_id as seq, case event_type when 'error' then 'critical' when 'signup' then 'high' when 'view' then 'medium' else 'low' end as severity,
 case event_id % 4 when 0 then 'memory_safety' when 1 then 'security' when 2 then 'data_integrity' else 'code_quality' end as category,
 case event_id % 13 when 0 then 'strncpy 널 종료 누락' when 1 then 'SQLCA 체크 누락' when 2 then 'False Positive: length' when 3 then 'Race condition in handler' when 4 then 'Array index out of bounds' when 5 then 'Null pointer'
  when 6 then '지역 변수 ix 선언' when 7 then 'Indicator 변수 누락' when 8 then 'Wrong SVC_CNT' when 9 then '커서 close 확인' else 'Finding ' || (event_id % 7) end as title,
 case event_id % 6 when 0 then 'In load() a trace is kept' when 1 then '함수 save 의 정상 동작입니다' when 2 then '함수 copy 에서 mpfm_copy (a) 호출' when 3 then '함수 save 를 보라' else 'Plain | text' || repeat('x', cast(user_id % 5 as int)) end as description,
 cast(floor(coalesce(value, 0)) as bigint) % 60 as line_start, cast(floor(coalesce(value, 0)) as bigint) % 60 + event_id % 3 as line_end,
 case event_id % 3 when 0 then 'static_analysis' when 1 then 'llm' else 'hybrid' end as source, case when event_id % 3 = 0 then 'RULE_' || (event_id % 4) end as static_rule,
 case event_id % 9 when 0 then ' a = 1;' when 1 then '' else 'b' end as before, case event_id % 9 when 0 then 'a = 1; ' when 1 then '' else 'c' end as after, event_id as born from events"""
_DUCK = f"issue as ({_SQL})"
_RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end"
_RESULT = "select distinct c_custkey % 320 as file_id, case when c_custkey % 320 % 97 = 5 then 'failed' end as error from customer"


def _issues(spark, sf_dir):
    """`born` stays what `seq` was, for the SQL to say what a text is made of."""
    table(spark, sf_dir, "events").createOrReplaceTempView("sparkloupe_events")
    return spark.sql(_SQL.replace("from events", "from sparkloupe_events"))


def _results(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("sparkloupe_customer")
    return spark.sql(_RESULT.replace("from customer", "from sparkloupe_customer"))


#: What the text is made of, in place of the operators' lists of words.
_FP = "not (born % 13 = 2 or born % 6 = 1 or born % 9 = 0)"
_QUIET = "not (born % 13 = 3 or born % 6 = 0)"


@query(f"with {_DUCK} select * from issue where severity <> 'low'")
def w1_drop_low(spark, sf_dir):
    return I.drop_low(_issues(spark, sf_dir))


@query(f"with {_DUCK} select * from issue where {_FP} and seq % 10 <> 3")
def w2_false_positives(spark, sf_dir):
    """W2, with a flag on every tenth."""
    flagged = _issues(spark, sf_dir).withColumn("false_positive", F.when(F.col("seq") % 10 == 3, True).when(F.col("seq") % 10 == 4, False))
    return I.drop_false_positives(flagged).drop("false_positive")


@query(f"with {_DUCK} select * from issue where {_QUIET}")
def w3_noise(spark, sf_dir):
    return I.drop_noise(_issues(spark, sf_dir))


@query(f"with {_DUCK} select * from issue where not (born % 13 = 4 and born % 6 = 2)")
def w4_safe_bounds(spark, sf_dir):
    return I.drop_safe_bounds(_issues(spark, sf_dir))


_MORE = "case when g is not null and a > 1 then description || ' (외 ' || (a - 1) || '곳 동일 패턴)' else description end as description"


def _grouped(source: str) -> str:
    return f"""grp as (select *, case born % 13 when 0 then 1 when 6 then 2 when 1 then 3 when 7 then 4 when 9 then 5 end as g, case born % 6 when 1 then 'save' when 2 then 'copy' when 3 then 'save' else '-' end as f from {source}),
 num as (select *, row_number() over (partition by file_id, g, f order by {_RANK} desc, seq) as n, count(*) over (partition by file_id, g, f) as a, case when g is null then seq else min(seq) over (partition by file_id, g, f) end as low from grp),
 merged as (select * exclude (g, f, n, a, low) replace ({_MORE}, row_number() over (partition by file_id order by g is null, low) as seq) from num where g is null or n = 1)"""


@query(f"with {_DUCK}, {_grouped('issue')} select * from merged")
def w5_merge_groups(spark, sf_dir):
    return I.merge_groups(_issues(spark, sf_dir))


@query(f"""with {_DUCK}, grp as (select *, case born % 13 when 0 then 'a' when 6 then 'b' when 8 then 'c' || category end as g, case born % 13 when 0 then 0 when 6 then 0 when 8 then 1 else 2 end as part from issue where born % 13 <> 3),
 num as (select *, row_number() over (partition by file_id, g order by {_RANK} desc, seq) as n, count(*) over (partition by file_id, g) as a, case when g is null then seq else min(seq) over (partition by file_id, g) end as low from grp)
 select * exclude (g, part, n, a, low) replace ({_MORE}, row_number() over (partition by file_id order by {_RANK} desc, part, low) as seq) from num where g is null or n = 1""")
def w6_c_dedup(spark, sf_dir):
    return I.c_dedup(_issues(spark, sf_dir))


def _anchored(source: str) -> str:
    return f"""ord as (select *, row_number() over (partition by file_id, category order by seq) as k from {source}),
 anc as (select file_id, category, k, seq, seq as anchor_seq, [{{'s': seq, 'l': line_start}}] as open from ord where k = 1
  union all select o.file_id, o.category, o.k, o.seq, coalesce(list_filter(a.open, lambda c: abs(c.l - o.line_start) <= 3)[1].s, o.seq),
   case when len(list_filter(a.open, lambda c: abs(c.l - o.line_start) <= 3)) > 0 then a.open else list_append(a.open, {{'s': o.seq, 'l': o.line_start}}) end
  from anc a join ord o on o.file_id = a.file_id and o.category = a.category and o.k = a.k + 1)"""


@query(f"with recursive {_DUCK}, {_anchored('issue')} select file_id, seq, category, anchor_seq from anc")
def w7_anchors(spark, sf_dir):
    """The greedy clusters themselves."""
    return I.anchors(_issues(spark, sf_dir)).select("file_id", "seq", "category", "anchor_seq")


_BEST = "row_number() over (partition by file_id, category, anchor_seq order by case source when 'hybrid' then 3 when 'llm' then 2 else 1 end desc, " + _RANK + " desc, length(description) desc, seq) as best"


@query(f"with recursive {_DUCK}, {_anchored('issue')}, w as (select i.*, anchor_seq from issue i join anc using (file_id, category, seq)), b as (select *, {_BEST} from w) select * exclude (anchor_seq, best) from b where best = 1")
def w7_cross_layer_dedup(spark, sf_dir):
    return I.cross_layer_dedup(_issues(spark, sf_dir))


@query(f"with {_DUCK}, k as (select *, coalesce(static_rule, substr(title, 1, 40)) as key from issue), n as (select *, row_number() over (partition by file_id, line_start, key order by case when source = 'static_analysis' then 0 else 1 end, seq) as n, min(seq) over (partition by file_id, line_start, key) as low from k) select * exclude (key, n, low) replace (low as seq) from n where n = 1")
def w9_keyed_dedup(spark, sf_dir):
    return I.keyed_dedup(_issues(spark, sf_dir))


@query(f"with {_DUCK} select * from issue qualify row_number() over (partition by file_id, line_start, line_end, category, title order by seq) = 1")
def w10_exact_dedup(spark, sf_dir):
    return I.exact_dedup(_issues(spark, sf_dir))


@query(f"with {_DUCK} select *, printf('PC-%03d', row_number() over (partition by file_id order by {_RANK} desc, seq)) as issue_id from issue")
def w12_renumber(spark, sf_dir):
    return I.renumber(_issues(spark, sf_dir))


@query(f"with {_DUCK}, p as (select *, row_number() over (partition by file_id, func_name order by {_RANK} desc, case source_layer when 'static' then 2 when 'cross' then 1 else 0 end desc, seq) as position, count(*) over (partition by file_id, func_name) as all_of_func, count(*) over (partition by file_id) as m from (select *, 'fn_' || (line_start // 30) as func_name, case seq % 5 when 0 then 'cross' when 1 then 'llm' else 'static' end as source_layer from issue)) select * exclude (m) from p where position <= 15 or m <= 20")
def w14_top_findings(spark, sf_dir):
    layer = F.when(F.col("seq") % 5 == 0, "cross").when(F.col("seq") % 5 == 1, "llm").otherwise("static")
    return I.top_findings(_issues(spark, sf_dir).withColumns({"func_name": F.concat(F.lit("fn_"), F.floor(F.col("line_start") / 30).cast("string")), "source_layer": layer}))


@query(f"with {_DUCK}, p as (select file_id, seq, 'fn_' || (line_start // 30) as func_name, case seq % 5 when 0 then 'MALLOC_NO_CHECK' else 'OTHER' end as rule_id from issue), n as (select *, row_number() over (partition by file_id, func_name order by rule_id = 'OTHER', seq) as position, count(*) over (partition by file_id, func_name) as n from p) select *, greatest(n - 3, 0) as more from n where position <= 3")
def a6_function_findings(spark, sf_dir):
    rule = F.when(F.col("seq") % 5 == 0, "MALLOC_NO_CHECK").otherwise("OTHER")
    rows = _issues(spark, sf_dir).select("file_id", "seq", F.concat(F.lit("fn_"), F.floor(F.col("line_start") / 30).cast("string")).alias("func_name"), rule.alias("rule_id"))
    return I.function_findings(rows, 3, I.FIRST_RULES)


@query(f"with {_DUCK} select *, row_number() over (order by {_RANK} desc, file_id, seq) as position from issue")
def w13_global_order(spark, sf_dir):
    from ..sources.files import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return I.global_order(_issues(spark, sf_dir))


@query(f"""with {_DUCK}, f as (select *, case seq % 5 when 0 then 'LOOP_INIT_MISSING' when 1 then 'CURSOR_DUPLICATE_CLOSE' when 2 then 'FORMAT_ARG_MISMATCH' when 3 then 'FORMAT_STRUCT' else 'MEMSET_SIZEOF_MISMATCH' end as r, case seq % 2 when 0 then 'v' || (seq % 3) else '' end as v from issue),
 p as (select *, case when v = '' then '<var>' else v end as w from f where seq % 5 <> 4)
 select file_id, seq, printf('PC-S-%03d', row_number() over (partition by file_id order by seq)) as issue_id, case seq % 5 when 0 then 'data_integrity' when 1 then 'error_handling' else 'memory_safety' end as category, severity,
 case seq % 5 when 0 then '루프 내 구조체 초기화 누락' when 1 then 'cursor 중복 close' when 2 then 'printf 포맷 지정자/인자 개수 불일치' else '%s 포맷에 구조체 직접 전달' end || case when v <> '' then ' (' || v || ')' else '' end as title, description, line_start, case seq % 5 when 1 then line_start + 7 else line_start end as line_end,
 case when before = '' then '(원본 코드 라인)' else before end as before, case seq % 5 when 0 then '루프 시작에 INIT2VCHAR(' || w || '); 또는 memset(&' || w || ', 0, sizeof(' || w || ')); 추가' when 1 then 'cursor ' || w || '의 close 경로를 한 곳으로 통합 (조건문/break 정리하여 제어 흐름 단일화)' when 2 then '포맷 지정자 ' || seq % 4 || '개와 실제 인자 ?개를 일치시키도록 정렬' else '구조체 전체가 아닌 문자열 멤버(.field) 접근으로 변경' end as after,
 'static_analysis' as source, 'proc_heuristic' as static_tool, r as static_rule from p""")
def w8_promote(spark, sf_dir):
    k = F.col("seq") % 5
    rule = F.when(k == 0, "LOOP_INIT_MISSING").when(k == 1, "CURSOR_DUPLICATE_CLOSE").when(k == 2, "FORMAT_ARG_MISMATCH").when(k == 3, "FORMAT_STRUCT").otherwise("MEMSET_SIZEOF_MISMATCH")
    variable = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("v"), (F.col("seq") % 3).cast("string"))).otherwise("")
    lines = F.when(k == 1, F.array(F.col("line_start") + 7, F.col("line_start")))
    rows = _issues(spark, sf_dir).select("file_id", "seq", rule.alias("rule_id"), "severity", variable.alias("variable"), F.col("line_start").alias("line_no"), lines.alias("all_lines"), (F.col("seq") % 4).alias("format_count"), F.lit(None).cast("long").alias("arg_count"), F.col("before").alias("content"), "description")
    return I.promote(rows)


@query(f"with {_DUCK}, quiet as (select * from issue where {_QUIET}), {_grouped('quiet')} select *, printf('PC-%03d', row_number() over (partition by file_id order by {_RANK} desc, seq)) as issue_id from merged")
def w20_merge_fallback(spark, sf_dir):
    return I.merge_fallback(_issues(spark, sf_dir))


_MERGED = f"{_DUCK}, quiet as (select * from issue where {_FP} and {_QUIET}), {_grouped('quiet')}, {_anchored('merged')}, w as (select i.*, anchor_seq from merged i join anc using (file_id, category, seq)), b as (select *, {_BEST} from w), final as (select * exclude (anchor_seq, best), printf('PC-%03d', row_number() over (partition by file_id order by {_RANK} desc, seq)) as issue_id from b where best = 1)"


@query(f"with recursive {_MERGED} select * from final")
def w21_merge(spark, sf_dir):
    return I.merge(_issues(spark, sf_dir))


@query(f"with {_DUCK} select " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in I.SEVERITY_RANK) + " from issue")
def a1_severity_histogram(spark, sf_dir):
    return I.severity_histogram(_issues(spark, sf_dir))


@query(f"with {_DUCK} select 'severity' as dimension, severity as value, count(*) as n from issue group by all union all select 'category', category, count(*) from issue group by all union all select 'file_id', file_id::varchar, count(*) from issue group by all union all select 'total', '', count(*) from issue")
def a2_summary(spark, sf_dir):
    return I.summary(_issues(spark, sf_dir), "severity", "category", "file_id")


_COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in I.SEVERITY_RANK)


@query(f"with {_DUCK}, c as (select {_COUNTS} from issue), e as (select count(error) as errors, count(*) as files from ({_RESULT})) select files, errors, critical, high, medium, low, case when errors > 0 then 'UNABLE_TO_ANALYZE' when critical > 0 then 'CRITICAL' when high >= 3 then 'HIGH' when high >= 1 then 'MEDIUM' else 'LOW' end as risk, case when errors > 0 then 3 when critical > 0 then 1 else 0 end as exit_code from c, e")
def a3_overall_risk(spark, sf_dir):
    """A3, A10 and A14."""
    return I.overall_risk(_results(spark, sf_dir), _issues(spark, sf_dir))


@query("select count(*) as files, 0::bigint as errors, 0::bigint as critical, 0::bigint as high, 0::bigint as medium, 0::bigint as low, 'LOW' as risk, 2 as exit_code from (select distinct c_custkey % 320 from customer)")
def a14_file_errors(spark, sf_dir):
    """Nothing but files that can't be read, and so no issue."""
    none = spark.createDataFrame([], "file_id long, severity string")
    return I.overall_risk(_results(spark, sf_dir).withColumn("file_error", F.lit("missing")), none)


@query(f"with {_DUCK} select file_id, 'X-' || seq as issue_id from issue where severity = 'critical'")
def a3_blocking(spark, sf_dir):
    return I.blocking(_issues(spark, sf_dir).withColumn("issue_id", F.concat(F.lit("X-"), F.col("seq").cast("string"))))


_FILE_RISK = f"c as (select file_id, {_COUNTS} from issue group by file_id), r as (select r.file_id, error, " + ", ".join(f"case when error is not null then 0 else coalesce({s}, 0) end as {s}" for s in I.SEVERITY_RANK) + f" from ({_RESULT}) r left join c using (file_id)), v as (select *, case when error is not null then 'UNABLE_TO_ANALYZE' when critical > 0 then 'CRITICAL' when high >= 3 then 'HIGH' when high >= 1 then 'MEDIUM' else 'LOW' end as risk from r)"


@query(f"with {_DUCK}, {_FILE_RISK} select file_id, critical, high, medium, low, risk, risk not in ('UNABLE_TO_ANALYZE', 'CRITICAL') as allowed from v")
def a4_file_risk(spark, sf_dir):
    return I.file_risk(_results(spark, sf_dir), _issues(spark, sf_dir))


_PATH = "case file_id % 3 when 0 then 'src/f' || file_id || '.c' when 1 then 'my dir/f' || file_id || '.pc' else 'o''f' || file_id || '.js' end"


def _word(c: str) -> str:
    quote = "chr(39)"
    return f"case when regexp_matches({c}, '^[A-Za-z0-9_./-]+$') then {c} else {quote} || replace({c}, {quote}, {quote} || chr(34) || {quote} || chr(34) || {quote}) || {quote} end"


def _checks(source: str) -> str:
    return f"""placed as (select *, {_PATH} as path from {source} where severity in ('critical', 'high')),
 checked as (select category, file_id, path, count(*) as n, string_agg(issue_id, ', ' order by seq) as related, max_by(severity, {_RANK}) as severity, min_by(title, seq) as first_title, min(seq) as first_seq, case min_by(born, seq) % 13 when 1 then 'EXEC SQL' when 7 then 'INDICATOR' when 9 then 'OPEN\\|CLOSE' else 'TODO' end as pattern from placed group by category, file_id, path),
 said as (select *, 'grep -n ' || case category when 'data_integrity' then chr(39) || 'EXEC SQL' || chr(39) else {_word("pattern")} end || ' ' || {_word("path")} as command, case category when 'memory_safety' then '매칭 결과 없음 (0건)' when 'security' then '매칭 결과 없음 (0건)' when 'data_integrity' then '모든 EXEC SQL 후 SQLCA 체크 존재' else '코드 품질 개선 완료' end as expected,
  '모든 ' || case category when 'memory_safety' then '메모리 안전성' when 'security' then '보안' when 'data_integrity' then '데이터 무결성' else '코드 품질' end || ' 이슈 수정 완료 (' || path || ')' as description from checked)"""


def _placed(rows):
    k = F.col("file_id").cast("string")
    path = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("src/f"), k, F.lit(".c"))).when(F.col("file_id") % 3 == 1, F.concat(F.lit("my dir/f"), k, F.lit(".pc"))).otherwise(F.concat(F.lit("o'f"), k, F.lit(".js")))
    return rows.withColumn("path", path)


@query(f"with {_DUCK}, tagged as (select *, 'X-' || seq as issue_id from issue), {_checks('tagged')} select * from said")
def a8_checklist(spark, sf_dir):
    rows = _placed(_issues(spark, sf_dir)).withColumn("issue_id", F.concat(F.lit("X-"), F.col("seq").cast("string")))
    return I.checklist(rows).withColumn("related", F.array_join("related", ", "))


_FILE = "select p_partkey as file_id, 'src/f' || p_partkey || case p_size % 6 when 0 then '.js' when 1 then '.c' when 2 then '.h' when 3 then '.pc' when 4 then '.sql' else '.xml' end as path, case p_partkey % 4 when 0 then '/* Module code */' when 1 then '/* screen */' when 2 then 'int module;' else '// SERVICE module' end as first_line, cast(p_size * 10 as bigint) as line_count from part"


def _paths(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("sparkloupe_part")
    return spark.sql(_FILE.replace("from part", "from sparkloupe_part"))


_SECTION_SQL = f"f as ({_FILE}), g as (select case when path like '%.xml' or path like '%.js' then 'screen' when path like '%.c' and first_line = '/* Module code */' then 'module' when path like '%.c' then 'tp' when path like '%.h' then 'module' when path like '%.pc' then 'batch' else 'dbio' end as section from f)"


@query(f"with {_SECTION_SQL} select section, count(*) as files, case section when 'screen' then 0 when 'tp' then 1 when 'module' then 2 when 'batch' then 3 else 4 end as position from g group by section")
def a9_deployment_sections(spark, sf_dir):
    return I.deployment_sections(_paths(spark, sf_dir))


@query(f"with {_SECTION_SQL} select section, item_no, case section when 'screen' then 'SCR' when 'tp' then 'TP' when 'module' then 'MOD' when 'batch' then 'BAT' else 'DBI' end || printf('-%02d', item_no) as item_id, case section when 'screen' then '화면 배포 (xml/js)' when 'tp' then 'TP 배포 (.c)' when 'module' then 'Module 배포 (.c/.h)' when 'batch' then 'Batch 배포 (.pc)' else 'DBIO 배포 (.sql)' end as title from (select distinct section from g) s, (select unnest(range(1, 9)) as item_no) n where item_no <= case section when 'screen' then 5 when 'tp' then 7 when 'module' then 8 when 'batch' then 7 else 6 end")
def a9_deployment_items(spark, sf_dir):
    """The fixed items of the sections that have files."""
    return I.deployment_items(I.deployment_sections(_paths(spark, sf_dir)).select("section")).select("section", "item_no", "item_id", "title")


@query(f"with f as (select *, case regexp_extract(path, '\\.(\\w+)$', 1) when 'js' then 'javascript' when 'c' then 'c' when 'h' then 'c' when 'pc' then 'proc' else regexp_extract(path, '\\.(\\w+)$', 1) end as language from ({_FILE})), s as (select *, case language when 'javascript' then 15 when 'c' then 20 when 'proc' then 25 else 10 end as sec from f) select coalesce(language, '(all)') as language, count(*) as files, sum(line_count)::bigint as lines, sum(sec)::bigint as seconds from s group by rollup (language)")
def a11_estimated_seconds(spark, sf_dir):
    """S7, A10 and A11."""
    from ..sources.files import with_language

    return I.estimated_seconds(with_language(_paths(spark, sf_dir)))


#: The files of the reports, and the merged issues as cards, rows of contents and parts of documents.
_REPORT_FILE = f"report_file as (select r.file_id, {_PATH} as path, case file_id % 3 when 0 then 'c' when 1 then 'proc' else 'javascript' end as language, file_id * 100 as line_count, error from ({_RESULT}) r)"
_KIND = "case category when 'memory_safety' then '메모리 안전성' when 'security' then '보안' when 'data_integrity' then '데이터 무결성' else '코드 품질' end"
_HEAD = "'[' || upper(severity) || '] ' || issue_id || ' ' || title"
_NL = "chr(10)"
_CARD = f"""card as (select f.file_id, m.seq, m.severity, issue_id, regexp_replace(regexp_replace(lower({_HEAD}), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', '-', 'g') as anchor, category, source, title, description, before, after, line_start, line_end, path, language,
 '### ' || {_HEAD} || {_NL} || '- **위치**: `' || path || case when line_start = 0 then '' when line_end <> line_start then ':' || line_start || '~' || line_end else ':' || line_start end || '`' || {_NL} || '- **분류**: `' || category || '` (' || {_KIND} || ')' || {_NL} || '- **출처**: ' || source || {_NL}
 || {_NL} || '#### 설명' || {_NL} || description || {_NL} || case when before <> '' then {_NL} || '#### 수정 전' || {_NL} || '```' || b || {_NL} || before || {_NL} || '```' || {_NL} else '' end || case when after <> '' then {_NL} || '#### 수정 후' || {_NL} || '```' || b || {_NL} || after || {_NL} || '```' || {_NL} else '' end as card
 from final m join (select *, case language when 'proc' then 'c' else language end as b from report_file) f using (file_id)),
 toc as (select *, '| ' || upper(severity) || ' | ' || issue_id || ' | ' || title || ' | ' || category || ' | ' || source || ' | [링크](#' || anchor || ') |' as toc from card)"""


def _report_inputs(spark, sf_dir):
    k = F.col("file_id") % 3
    files = _placed(_results(spark, sf_dir)).withColumns({"language": F.when(k == 0, "c").when(k == 1, "proc").otherwise("javascript"), "line_count": F.col("file_id") * 100, "first_line": F.lit("/* x */")})
    return files, I.merge(_issues(spark, sf_dir))


@query(f"with recursive {_MERGED}, {_REPORT_FILE}, {_CARD} select file_id, issue_id, anchor, toc, card from toc")
def o2_cards(spark, sf_dir):
    return R.cards(*_report_inputs(spark, sf_dir))


_SORTED = f"order by {_RANK} desc, seq"
_RISK_NAME = "case risk when 'CRITICAL' then 'CRITICAL (즉시 조치 필요)' when 'HIGH' then 'HIGH (조치 권고)' when 'MEDIUM' then 'MEDIUM (검토 권고)' when 'LOW' then 'LOW (양호)' else '분석 불가' end"
_MAY = "case when risk in ('CRITICAL', 'UNABLE_TO_ANALYZE') then '불가' else '가능' end"
_PARTS = f"""counted as (select f.file_id, f.path, f.language, f.line_count, f.error, coalesce(c.total, 0) as total, {", ".join(f"case when error is null then coalesce(c.{s}, 0) else 0 end as {s}" for s in I.SEVERITY_RANK)} from report_file f left join (select file_id, count(*) as total, {_COUNTS} from final group by file_id) c using (file_id)),
 judged as (select *, case when error is not null then 'UNABLE_TO_ANALYZE' when critical > 0 then 'CRITICAL' when high >= 3 then 'HIGH' when high >= 1 then 'MEDIUM' else 'LOW' end as risk from counted),
 kinds as (select file_id, string_agg('| ' || {_KIND} || ' (`' || category || '`) | ' || n || ' |', {_NL} order by n desc, category) as kinds from (select file_id, category, count(*) as n from final group by all) group by file_id),
 lists as (select file_id, string_agg(toc, {_NL} {_SORTED}) as toc, string_agg(card || {_NL} || {_NL}, '' {_SORTED}) as cards, string_agg(card || {_NL} || {_NL}, '' {_SORTED}) filter (severity in ('critical', 'high')) as urgent from toc group by file_id),
 {_checks("final")}, numbered_check as (select *, row_number() over (partition by file_id order by first_seq, category) as no from said),
 checks as (select file_id, string_agg('- [ ] **[' || upper(severity) || ']** CHECK-' || no || ': ' || description || {_NL} || '  - 관련 이슈: ' || related || {_NL} || '  - 검증: `' || command || '`' || {_NL} || '  - 기대 결과: ' || expected, {_NL} order by severity <> 'critical', no) as checks from numbered_check group by file_id)"""


def _text(*lines: str) -> str:
    return f" || {_NL} || ".join(lines)


_ITEMS = {"c": ("tp", "TP 배포 (.c)", "TP"), "proc": ("batch", "Batch 배포 (.pc)", "BAT"), "javascript": ("screen", "화면 배포 (xml/js)", "SCR")}
_DEPLOY = "case language " + " ".join(f"when '{lang}' then " + _text(f"'### {title}'", "''", "'- 파일: `' || path || '`'", "''", *[f"'- [ ] {prefix}-{i + 1:02d}: {x}'" for i, x in enumerate(I.SECTIONS[k][3])]) for lang, (k, title, prefix) in _ITEMS.items()) + " end"
_KIND_TABLES = _text("'### 카테고리별 이슈'", "''", "'| 카테고리 | 건수 |'", "'|----------|------|'", "kinds", "''", "'### 언어별 이슈'", "''", "'| 언어 | 건수 |'", "'|------|------|'", "'| ' || upper(language) || ' | ' || total || ' |'", "''", "'### 파일별 이슈'", "''", "'| 파일 | 건수 |'", "'|------|------|'", "'| `' || path || '` | ' || total || ' |'", "''")
_DOCUMENT = _text(
    "'# 분석 리포트'", "''", "'- **분석 시각**: 2026-04-04 22:31'", "'- **분석 대상**:'", "'  - `' || path || '`'", "''", "'---'", "''",
    "'## 분석 요약'", "''", "'| 항목 | 값 |'", "'|------|-----|'", "'| 총 이슈 수 | ' || total || ' |'", "'| Critical | ' || critical || ' |'", "'| High | ' || high || ' |'", "'| Medium | ' || medium || ' |'", "'| Low | ' || low || ' |'",
    f"'| 배포 위험도 (전체) | ' || {_RISK_NAME} || ' |'", f"'| 배포 가능 여부 (전체) | ' || {_MAY} || ' |'", "'| 분석 시간 | 2분 5초 |'", "'| LLM 토큰 | 12,345 |'", "''",
    "'### 파일별 배포 판정'", "''", "'| 파일 | Critical | High | Medium | 배포 위험도 | 배포 |'", "'|------|---------|------|--------|-----------|-----|'", f"'| `' || path || '` | ' || critical || ' | ' || high || ' | ' || medium || ' | ' || {_RISK_NAME} || ' | ' || {_MAY} || ' |'", "''",
    f"case when kinds is null then '' else {_KIND_TABLES} || {_NL} end || '---'", "''",
    "'## 전체 이슈 목차(표)'", "''", "case when toc is null then '> 이슈 없음' else '| 레벨 | 순번 | 제목 | 분류 | 출처 | 앵커 |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || toc end", "''", "'---'", "''",
    "'## 핵심 이슈 (Critical / High)'", "''", f"case when urgent is null then '> 핵심 이슈 없음' || {_NL} || {_NL} else urgent end || '---'", "''",
    "'## 전체 이슈 목록'", "''", f"case when cards is null then '> 주요 이슈 없음' || {_NL} || {_NL} else cards end || '---'", "''",
    "'## 검증 체크리스트'", "''", "coalesce(checks, '> 해당 없음')", "''", "'---'", "''",
    "'## 배포 체크리스트'", "''", _DEPLOY, "''", "'---'", "''",
    "'## 메타데이터'", "''", "'- **세션 ID**: `s1`'", "'- **분석 파일 수**: 1'", "'- **총 라인 수**: ' || case when line_count >= 1000 then (line_count // 1000) || ',' || lpad((line_count % 1000)::varchar, 3, '0') else line_count::varchar end || '줄'", "''",
)


@query(f"with recursive {_MERGED}, {_REPORT_FILE}, {_CARD}, {_PARTS} select j.file_id, {_DOCUMENT} as markdown from judged j left join kinds using (file_id) left join lists using (file_id) left join checks using (file_id)")
def o1_markdown(spark, sf_dir):
    """O1: a document of eight sections for each file."""
    return R.markdown(*_report_inputs(spark, sf_dir), session="s1", at="2026-04-04T22:31:00.123456Z", seconds=125.4, tokens=12345)


_ISSUE_JSON = """'{"issue_id":"' || issue_id || '","category":"' || category || '","severity":"' || severity || '","title":"' || title || '","description":"' || description || '","location":{"file":"' || path || '","line_start":' || line_start || ',"line_end":' || line_end || '},"fix":{"before":"' || before || '","after":"' || after || '"},"source":"' || source || '"}'"""
_DEPLOY_JSON = "case language " + " ".join(f"""when '{lang}' then '{{"total_items":{len(I.SECTIONS[k][3])},"sections":[{{"section_id":"{k}","title":"{title}","files":["' || path || '"],"items":[""" + ",".join(f'{{"id":"{prefix}-{i + 1:02d}","item":"{x}"}}' for i, x in enumerate(I.SECTIONS[k][3])) + "]}]}'" for lang, (k, title, prefix) in _ITEMS.items()) + " end"


@query(f"""with recursive {_MERGED}, {_REPORT_FILE}, {_CARD}, {_PARTS}, listed as (select file_id, string_agg({_ISSUE_JSON}, ',' {_SORTED}) as listed from card group by file_id),
 check_list as (select file_id, count(*) as n, string_agg('{{"id":"CHECK-' || no || '","category":"' || category || '","severity":"' || severity || '","description":"' || description || '","related_issues":["' || replace(related, ', ', '","') || '"],"verification_command":"' || replace(replace(command, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '","expected_result":"' || expected || '"}}', ',' order by severity <> 'critical', no) as checked from numbered_check group by file_id)
 select j.file_id, '{{"total_issues":' || total || ',"issues":[' || coalesce(listed, '') || ']}}' as issue_list, '{{"total_checks":' || coalesce(n, 0) || ',"items":[' || coalesce(checked, '') || ']}}' as checklist,
 '{{"issue_summary":{{"total":' || total || ',"by_severity":{{"critical":' || critical || ',"high":' || high || ',"medium":' || medium || ',"low":' || low || '}}}},"risk_assessment":{{"deployment_risk":"' || risk || '","deployment_allowed":' || case when risk in ('CRITICAL', 'UNABLE_TO_ANALYZE') then 'false' else 'true' end || '}}}}' as summary,
 {_DEPLOY_JSON} as deployment_checklist from judged j left join listed using (file_id) left join check_list using (file_id)""")
def o3_json_documents(spark, sf_dir):
    return R.json_documents(*_report_inputs(spark, sf_dir))


@query("select p_partkey as node, cast(floor(log2(greatest(p_partkey, 1))) as int) as level, false as cyclic from part union all select 1000000001, cast(floor(log2(max(p_partkey))) + 1 as int), true from part union all select 1000000002, cast(floor(log2(max(p_partkey))) + 1 as int), true from part")
def h3_topological_levels(spark, sf_dir):
    """H1 to H3: every part depends on the part of half its number; two more nodes depend on each other."""
    from ..sources.files import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    part = table(spark, sf_dir, "part")
    cycle = spark.createDataFrame([(1000000001, 1000000002), (1000000002, 1000000001)], "src long, dst long")
    edges = part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")).union(cycle)
    return I.topological_levels(part.select(F.col("p_partkey").alias("node")).union(cycle.select("src")), edges)
