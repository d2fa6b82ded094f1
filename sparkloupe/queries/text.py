"""Queries straight on documents, pages and conversations: personal data, verdicts, markup, scripts, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import markup as M
from ..operators import one_pass as O
from ..operators import pii as P
from ..operators import search as S
from ..operators import structure as X
from ..plans import verdict
from ..sources.files import first_line
from ._base import PROC_DUCK, proc_lines, query, table

#: The rules in the SQL's own words: (rule, severity, pattern, on masked text); in order of priority.
_NAMES = "Kim|Lee|Park|Choi|Jung|Jang|Cho|Kang|Lim|Han|Yoon|Jeon|Shin|Kwon|Hwang|Ahn|Hong|Yang|Bae|Baek|Hur|Nam|Seong|Sim|Yuk|Gil|Heo|Pyo|Yeo|Chae|Noh|Joo|Koo"
_RULES = (
    ("foreigner_registration", "high", r"\b[0-9]{6}-[5-8][0-9]{6}\b", True),
    ("resident_registration", "critical", r"\b[0-9]{6}-[0-9]{7}\b", True),
    ("phone", "high", r"\b(01[016789]|02|0[3-9][0-9])[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}\b", True),
    ("card", "high", r"\b[0-9]{4}[-\s][0-9]{4}[-\s][0-9]{4}[-\s][0-9]{4}\b", True),
    ("passport", "high", r"\b[A-Z]{1,2}[0-9]{7,8}\b", True),
    ("driver_licence", "high", r"\b[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}\b", True),
    ("business_number", "medium", r"\b(1533|1544|1555|1566|1577|1588|1599|1600|1644|1661|1666|1670|1688|1800|1855|1877|1899)[-\s]?[0-9]{4}\b", False),
    ("safety_number", "high", r"\b0507[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}\b", False),
    ("email", "medium", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False),
    ("imsi", "critical", r"\b450[0-9]{12}\b", False),
    ("iccid", "critical", r"\b89[0-9]{17,19}\b", False),
    ("imei", "critical", r"\b[0-9]{15}\b", False),
    ("romanised_name", "medium", rf"\b({_NAMES})[\s.-][A-Z][a-z]{{2,6}}([\s.-][A-Z]?[a-z]{{2,6}})?\b", False),
    ("romanised_name", "medium", rf"\b[A-Z][a-z]{{2,6}}[\s.-]({_NAMES})\b", False),
    ("aws_key", "critical", r"\bAKIA[0-9A-Z]{16}\b", False),
    ("github_token", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36,}", False),
    ("jwt", "high", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False),
    ("google_key", "critical", r"\bAIza[0-9A-Za-z_-]{35}", False),
    ("stripe_key", "critical", r"\b[rs]k_live_[0-9A-Za-z]{16,}", False),
    ("password", "high", r"(?i)\b(password|passwd|pwd|token|secret)\s*[:=]\s*[\"'][^\"'\s]{4,}[\"']", False),
    ("db_url", "high", r"(?i)\b(postgres|postgresql|mysql|oracle|mongodb)://[^\s:/@]+:[^\s@]+@[^\s]+", False),
)


def _found(no: int, rule: str, severity: str, pattern: str, masked: bool, source: str = "shown") -> str:
    column = "hidden" if masked else "text"
    return f"""select doc_id, {no} as prio, '{rule}' as rule, '{severity}' as severity, start, start + length(m[i]) as "end", substr(text, start + 1, length(m[i])) as value from (select doc_id, text, m, i, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as start from (select doc_id, text, p, m, unnest(range(1, len(m) + 1)) as i from (select doc_id, text, string_split_regex({column}, $r${pattern}$r$) as p, regexp_extract_all({column}, $r${pattern}$r$) as m from {source})))"""


_HIDDEN = "array_to_string(list_transform(range(1, len(hp) + 1), lambda i: hp[i] || coalesce(substr(hm[i], 1, 1) || repeat('0', length(hm[i]) - 1), '')), '')"
_SHOWN = f"shown as materialized (select doc_id, text, {_HIDDEN} as hidden from (select doc_id, text, string_split_regex(text, '[0-9]{{6,}}') as hp, regexp_extract_all(text, '[0-9]{{6,}}') as hm from documents where text is not null))"
#: A number's check digit, from the right, every second digit doubled.
_LUHN = "list_sum(list_transform(range(1, 16), lambda k: case when k % 2 = 1 then substr(value, k, 1)::int else (substr(value, k, 1)::int * 2) // 10 + (substr(value, k, 1)::int * 2) % 10 end)) % 10 = 0"
_FINDING = f"""{_SHOWN}, every_find as ({" union all ".join(_found(i, *r) for i, r in enumerate(_RULES))}),
 finding as (select doc_id, rule, severity, start, "end", value from (select *, row_number() over (partition by doc_id, start, "end" order by prio) as n from every_find where (rule <> 'imei' or {_LUHN}) and not (regexp_matches(value, '[0-9]{{6}}') and list_bool_and(list_transform(regexp_extract_all(value, '[0-9]{{6,}}'), lambda g: regexp_matches(g, '^[0-9]0*$'))))) where n = 1)"""


def _findings(spark, sf_dir):
    return P.scan(table(spark, sf_dir, "documents"), P.RULES + P.SECRETS)


@query(f"with {_FINDING} select * from finding")
def d1_pii_findings(spark, sf_dir):
    """Personal data and secrets with their places."""
    return _findings(spark, sf_dir)


_PLACE = """length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 as line_no, length(string_split(substr(text, 1, start), chr(10))[-1]) + 1 as column_no"""


@query(f"with {_FINDING} select f.doc_id, rule, start, {_PLACE} from finding f join documents d using (doc_id)")
def d4_positions(spark, sf_dir):
    return P.positions(_findings(spark, sf_dir), table(spark, sf_dir, "documents"))


_VEILED = "case when length(value) <= 4 then repeat('*', length(value)) else substr(value, 1, greatest(2, length(value) // 4)) || repeat('*', length(value) - greatest(2, length(value) // 4)) end as shown"


@query(f"with {_FINDING}, w as (select f.doc_id as file_id, rule, severity, {_PLACE}, {_VEILED}, text from finding f join documents d using (doc_id)) select file_id, rule, severity, line_no, column_no, substr(trim(string_split(text, chr(10))[line_no], ' '), 1, 120) as code, shown from w")
def d5b_file_scan(spark, sf_dir):
    return P.file_scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")), P.RULES + P.SECRETS)


@query(f"with {_FINDING} select doc_id, rule, {_VEILED}, case when length(value) % 2 = 1 then substr(value, 1, length(value) // 2) || '*' || substr(value, length(value) // 2 + 2) else substr(value, 1, length(value) // 2 - 1) || '**' || substr(value, length(value) // 2 + 2) end as centre from finding")
def d5_display_masks(spark, sf_dir):
    """D5 and D7."""
    f = _findings(spark, sf_dir)
    return f.select("doc_id", "rule", P.display_mask(F.col("value")).alias("shown"), P.centre_mask(F.col("value")).alias("centre"))


#: Every place that a rule matches, on the text as it is, as runs that don't touch.
_MASK = f"""plain as materialized (select doc_id, text, text as hidden from documents where text is not null), spot as ({" union all ".join(_found(i, *r, source="plain") for i, r in enumerate(_RULES))}),
 near as (select doc_id, start, "end", coalesce(max("end") over (partition by doc_id order by start, "end" rows between unbounded preceding and 1 preceding), -1) as reach from spot),
 run as (select doc_id, min(start) as a, max("end") as b from (select *, sum(case when start > reach then 1 else 0 end) over (partition by doc_id order by start, "end") as no from near) group by doc_id, no),
 piece as (select doc_id, a, repeat('*', b - a) as stars, substr(text, coalesce(lag(b) over w, 0) + 1, a - coalesce(lag(b) over w, 0)) as before, b from run join documents using (doc_id) window w as (partition by doc_id order by a)),
 joined as (select doc_id, string_agg(before || stars, '' order by a) as front, max(b) as last from piece group by doc_id)"""


@query(f"with {_MASK} select doc_id, case when text is not null then coalesce(front || substr(text, last + 1), text) end as masked from documents left join joined using (doc_id)")
def d6_masked_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.masked_text(F.col("text")).alias("masked"))


_RISK = f"with {_FINDING}, c as (select doc_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low")) + " from finding where severity <> 'low' group by doc_id), r as (select d.doc_id as file_id, " + ", ".join(f"case when text is null then 0 else coalesce({s}, 0) end as {s}" for s in ("critical", "high", "medium", "low")) + ", text is null as failed from documents d left join c using (doc_id)), v as (select *, case when failed then 'UNABLE_TO_ANALYZE' when critical > 0 then 'CRITICAL' when high >= 3 then 'HIGH' when high >= 1 then 'MEDIUM' else 'LOW' end as risk from r) select file_id, critical, high, medium, low, risk, risk not in ('UNABLE_TO_ANALYZE', 'CRITICAL') as allowed from v"


@query(_RISK)
def risk_verdict_documents(spark, sf_dir):
    """The flagship: which documents must not ship. Scan, drop low findings, verdict for each document (A4)."""
    return verdict.document_verdicts(table(spark, sf_dir, "documents"))


@query("select page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') as html from pages")
def p5_strip_xml(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_xml(F.col("html")).alias("html"))


@query("""with m as (select doc_id, string_split_regex(text, '[0-9]{6,}') as p, regexp_extract_all(text, '[0-9]{6,}') as m from documents)
 select doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(substr(m[i], 1, 1) || repeat('0', length(m[i]) - 1), '')), '') as masked from m""")
def p11_mask_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_digits(F.col("text")).alias("masked"))


@query("select doc_id, string_split(text, chr(10))[1] as first_line from documents")
def s8_first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", first_line(F.col("text")).alias("first_line"))


@query("select page_id as file_id, 1::bigint as script_no, 1::bigint as line_no, regexp_extract(html, '(?is)<script>(.*?)</script>', 1) as body from pages where regexp_matches(html, '(?is)<script>(.*?)</script>')")
def x22_inline_scripts(spark, sf_dir):
    return M.inline_scripts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("content")))


@query("select page_id as file_id, case when page_id % 3 = 0 then null when page_id % 3 = 1 then 'parse error' else 'refused' end as error from pages")
def x21_markup_gate(spark, sf_dir):
    """Pages have a DOCTYPE and are refused, but for those that are replaced: with markup, and with what isn't."""
    k = F.col("page_id") % 3
    content = F.when(k == 0, F.lit("<a><b/></a>")).when(k == 1, F.lit("<a><b></a>")).otherwise(F.col("html"))
    rows = M.parsed(table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), content.alias("content")))
    return rows.select("file_id", F.substring_index("x.error", ":", 1).alias("error"))


def _screens(spark, sf_dir):
    """A screen definition for each customer, with a list, columns, components and events."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    content = F.concat(F.lit('<?xml version="1.0"?>\n<screen id="s'), k, F.lit('">\n<dataList id="dl'), (F.col("c_custkey") % 3).cast("string"), F.lit('">\n<column id="a" name="A" dataType="text"/>\n<column id="b" name="B" dataType="number"/>\n</dataList>\n<input id="i'), (F.col("c_custkey") % 2).cast("string"), F.lit('" ev:onclick="scwin.f'), (F.col("c_custkey") % 4).cast("string"), F.lit('(1)" xmlns:ev="e"/>\n<input id="i0"/>\n</screen>'))
    return M.parsed(c.select(F.col("c_custkey").alias("file_id"), content.alias("content")))


@query("select c_custkey as file_id, 'dl' || c_custkey % 3 as list_id, c as column_id, upper(c) as name, case c when 'a' then 'text' else 'number' end as data_type, case c when 'a' then 4 else 5 end::bigint as line from customer, (values ('a'), ('b')) v(c)")
def x18_data_lists(spark, sf_dir):
    return M.xml_columns(_screens(spark, sf_dir))


@query("select c_custkey as file_id, 2::bigint as line, 'L2: dataList ID가 비어있거나 유효하지 않음: ''' || case c_custkey % 4 when 1 then ':' when 2 then '  ' else '' end || '''' as message from customer where c_custkey % 4 > 0")
def x18_list_errors(spark, sf_dir):
    k = F.col("c_custkey") % 4
    ident = F.when(k == 0, ' id="a"').when(k == 1, ' id=":"').when(k == 2, ' id="  "').otherwise("")
    content = F.concat(F.lit("<s>\n<dataList"), ident, F.lit('><column id="b"/></dataList></s>'))
    return M.list_errors(M.parsed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), content.alias("content"))))


@query("select c_custkey as file_id, 'i' || c_custkey % 2 as id, 'onclick' as event, 'f' || c_custkey % 4 as functions, 7::bigint as line from customer")
def x19_events(spark, sf_dir):
    """X17 and X19."""
    return M.xml_events(_screens(spark, sf_dir)).select("file_id", "id", "event", F.array_join("functions", ",").alias("functions"), "line")


@query("select c_custkey as file_id, 'i0' as id, 2::bigint as n, '7,8' as lines from customer where c_custkey % 2 = 0")
def x20_duplicate_ids(spark, sf_dir):
    return M.duplicate_ids(_screens(spark, sf_dir))


@query("select c_custkey as file_id, 'f3' as name, 7::bigint as line from customer where c_custkey % 4 = 3")
def j13_missing_handlers(spark, sf_dir):
    rows = _screens(spark, sf_dir)
    calls = rows.select("file_id", F.explode(F.array(*[F.lit(f"f{i}") for i in range(3)])).alias("name"))
    return M.handlers_without_script(M.xml_events(rows), calls)


@query("select c_custkey as file_id, 'dl' || c_custkey % 3 as list_id, 'dl' || c_custkey % 3 || ': 2 columns' as summary from customer")
def x31_list_summary(spark, sf_dir):
    return C.list_summary(M.xml_columns(_screens(spark, sf_dir)))


#: A script for each customer, of four kinds, and the same without its comments.
_SCRIPT = r"""case c_custkey % 4 when 0 then 'var a = ''x // y''; // note' when 1 then 'a = `t ${b /* in */} // no`; /* out */' when 2 then 'r = /a\/\/b[/]/; // c' else '#!/bin/js // x' || chr(10) || 'k = 1; /* m' || chr(10) || 'n */ z' end || chr(10) || 'id = ' || c_custkey || ';'"""
_BARE_SCRIPT = r"""case c_custkey % 4 when 0 then 'var a = ''x // y''; ' when 1 then 'a = `t ${b } // no`; ' when 2 then 'r = /a\/\/b[/]/; ' else '#!/bin/js // x' || chr(10) || 'k = 1; ' || chr(10) || ' z' end || chr(10) || 'id = ' || c_custkey || ';'"""


@query(f"select c_custkey as file_id, {_BARE_SCRIPT} as code from customer")
def p2_strip_js(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("sparkloupe_customer")
    rows = spark.sql("select c_custkey as file_id, " + _SCRIPT.replace("''", "\\'").replace("\\/", "\\\\/") + " as content from sparkloupe_customer")
    return rows.select("file_id", T.strip_js(F.col("content")).alias("code"))


@query("""select c_custkey as file_id, 1::bigint as line_no, case c_custkey % 7 when 0 then 'function_def' when 1 then 'function_def' when 2 then 'import' when 3 then 'import' when 4 then 'class_def' when 5 then 'event_listener' else 'dom_manipulation' end as pattern,
 case c_custkey % 7 when 0 then 'function go' || c_custkey when 1 then 'let f = (a) =>' when 2 then 'import x from "m"' when 3 then 'require("n")' when 4 then 'class A' when 5 then '.addEventListener("click"' else 'innerHTML =' end as match,
 case c_custkey % 7 when 0 then 'go' || c_custkey when 1 then 'f' when 2 then 'm' when 3 then 'n' when 4 then 'A' when 5 then 'click' end as capture from customer union all select c_custkey, 1, 'async_function', 'async function go' || c_custkey, 'go' || c_custkey from customer where c_custkey % 7 = 0""")
def g2_structural_js(spark, sf_dir):
    key = F.col("c_custkey")
    raw = F.when(key % 7 == 0, F.concat(F.lit("async function go"), key.cast("string"), F.lit("() {"))).when(key % 7 == 1, F.lit("let f = (a) => a;")).when(key % 7 == 2, F.lit('import x from "m";')).when(key % 7 == 3, F.lit('y = require("n");'))
    raw = raw.when(key % 7 == 4, F.lit("class A {")).when(key % 7 == 5, F.lit('b.addEventListener("click", c);')).otherwise(F.lit("d.innerHTML = e;"))
    return S.structural_search(table(spark, sf_dir, "customer").select(key.alias("file_id"), F.lit(1).cast("long").alias("line_no"), raw.alias("raw")), "javascript")


@query("with k as (select c_custkey as file_id, c_custkey % 3 as k from customer) select file_id, 1::bigint as script_no, 2::bigint as xml_start, 1::bigint as js_start, 1::bigint as length, 'var a = 1;' as body from k where k = 0 union all select file_id, 2, 5, 2, 2, 'b();' || chr(10) || 'if (c) d();' from k where k = 0 union all select file_id, 1, 2, 1, 1, 'return ' || file_id || ';' from k where k = 1")
def x22_cdata_scripts(spark, sf_dir):
    """Two sections and their places; one line, and a script with a source; and one without words of script."""
    key = F.col("c_custkey")
    two = F.lit("<s>\n<script><![CDATA[var a = 1;]]></script>\n<script type='x'>\n<![CDATA[\nb();\nif (c) d();]]>\n</script></s>")
    one = F.concat(F.lit("<s>\n<script><![CDATA[return "), key.cast("string"), F.lit(";]]></script>\n<script src='a'><![CDATA[var a;]]></script></s>"))
    content = F.when(key % 3 == 0, two).when(key % 3 == 1, one).otherwise(F.lit("<script><![CDATA[only text]]></script>\n<![CDATA[var b]]>"))
    return M.cdata_scripts(table(spark, sf_dir, "customer").select(key.alias("file_id"), content.alias("content")))


@query("with k as (select c_custkey as file_id, c_custkey % 3 as k, c_custkey % 5 as pos from customer) select file_id, 'NESTED_VAR_LOOP' as rule, 'critical' as severity, (pos + 2)::bigint as line, 'i' as variable from k where k = 0 union all select file_id, 'VAR_CLOSURE_LOOP', 'high', (pos + 2)::bigint, 'n' from k where k = 1")
def js_loop_rules(spark, sf_dir):
    """J-S1 and J-S2: scripts with up to four lines before their loop; the third kind has a loop without fault."""
    key = F.col("c_custkey")
    loop = F.when(key % 3 == 0, F.lit("for (var i = 0; i < 3; i++) {\n  for (var i = 0; i < 2; i++) {\n  }\n}")).when(key % 3 == 1, F.lit("for (var n = 0; n < 3; n++) {\n  setTimeout(function () { f(n); }, 1);\n}")).otherwise(F.lit("for (let i = 0; i < 3; i++) {\n  setTimeout(function () { f(i); }, 1);\n}"))
    content = F.concat(F.repeat(F.lit("x = 1;\n"), (key % 5).cast("int")), loop)
    return M.loop_rules(table(spark, sf_dir, "customer").select(key.alias("file_id"), content.alias("content")))


@query("with f as (select c_custkey as file_id, c_custkey % 7 + 1 as m from customer) select file_id, k as chunk_no, (k - 1) * 12 + 1 as line_start, least(k * 12, m * 6) as line_end from f, (select unnest(range(1, 6)) as k) where k <= (m + 1) // 2")
def x28_chunks(spark, sf_dir):
    """One to seven functions of six lines, cut at a function's end between 10 and 14 lines."""
    key = F.col("c_custkey")
    function = "function f() {\n  a();\n\n  b();\n  c();\n}"
    content = F.array_join(F.array_repeat(F.lit(function), (key % 7 + 1).cast("int")), "\n")
    return M.chunks(table(spark, sf_dir, "customer").select(key.alias("file_id"), content.alias("content")), 10, 14)


@query("with l as (select p_partkey as file_id, (p_size % 12 + 1)::bigint as line_no from part) select file_id, line_no, case when line_no <= 3 then line_no + 4 when line_no <= 8 then line_no + 16 else line_no end as file_line from l")
def j7_rebase(spark, sf_dir):
    """A line of joined scripts, the first of three lines from line 5 and the second of five from line 20."""
    part = table(spark, sf_dir, "part")
    scripts = part.select(F.col("p_partkey").alias("file_id"), F.inline(F.array(*[F.struct(F.lit(n).cast("long").alias("script_no"), F.lit(at).cast("long").alias("line_no"), F.lit(body).alias("body")) for n, at, body in ((1, 5, "a\nb\nc"), (2, 20, "d\ne\nf\ng\nh"))])))
    lines = part.select(F.col("p_partkey").alias("file_id"), (F.col("p_size") % 12 + 1).cast("long").alias("line_no"))
    return M.rebase(lines, M.script_order(scripts))


@query(f"with {PROC_DUCK}, d as (select file_id, line_no, ln from source_line where raw like '%int cnt;'), u as (select d.file_id, d.line_no, min_by(s.raw, s.line_no) as raw, 'fn_' || d.ln as func_name from d join source_line s on s.file_id = d.file_id and s.ln = d.ln and s.line_no > d.line_no and regexp_matches(s.raw, '\\bcnt\\b') group by d.file_id, d.line_no, d.ln) select file_id, func_name, 'cnt' as variable, line_no from u where not regexp_matches(raw, '\\bcnt\\s*=[^=]')")
def c1_uninitialised(spark, sf_dir):
    return O.uninitialised(S.source_files(proc_lines(spark, sf_dir)))


@query(f"with {PROC_DUCK} select file_id, line_no as line, case when raw like '%sprintf%' then 'sprintf' else 'printf' end as function, case when raw like '%sprintf%' then 1 else 2 end::bigint as conversions, case when raw like '%sprintf%' then 0 else 1 end::bigint as arguments from source_line where raw like '%printf(\"%' or raw like '%sprintf(%'")
def c10_format_mismatch(spark, sf_dir):
    """C10, with a second conversion put into every printf; sprintf lacks its argument as it is."""
    lines = proc_lines(spark, sf_dir).withColumn("raw", F.replace(F.replace(F.col("raw"), F.lit('printf("%d"'), F.lit('printf("%d 100%% %s"')), F.lit('strcat(x)", src)'), F.lit('strcat(x)")')))
    return M.format_mismatches(S.source_files(lines))


@query("select conv_id, turn, length(text) // 4 as tokens from conversations")
def p14_conversation_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))
