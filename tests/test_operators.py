"""Operators on small literals."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloupe.functions import text as T
from sparkloupe.operators import embedded_sql as E
from sparkloupe.operators import issues as I
from sparkloupe.operators import markup as M
from sparkloupe.operators import pii as P
from sparkloupe.operators import report as R
from sparkloupe.operators import search as S
from sparkloupe.operators import sql_lint as Q
from sparkloupe.operators import structure as X
from sparkloupe.sources import files as SF
from sparkloupe.sources import tool_output as TO


def one(spark, text, use):
    return spark.createDataFrame([(text,)], "t string").select(use(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a /* b\nc */ d", "a \n d"),
        ('s = "// no"; // yes', 's = "// no"; '),
        ("x /*+ INDEX(t) */ y", "x /*+ INDEX(t) */ y"),
        ("x /*+++ ruler */ y", "x  y"),
        ("c = '\"'; // z", "c = '\"'; "),
        ("open /* never closed\nb", "open \n"),
        ("", ""),
        ("a\r\n// b\r\nc", "a\r\n\r\nc"),
    ],
)
def test_strip_c(spark, text, want):
    assert one(spark, text, T.strip_c) == want


def test_strip_sql_and_proc(spark):
    assert one(spark, "a -- b\nc '--' /* d */ '' \"x--", T.strip_sql) == "a \nc '--'  '' \"x"
    assert one(spark, "i--; EXEC SQL SELECT a -- note\nFROM t; j--;", T.strip_proc) == "i--; EXEC SQL SELECT a \nFROM t; j--;"


@pytest.mark.parametrize(
    "text, want",
    [
        ("a = `x ${f(`// ${1} `)} // y`; // z", "a = `x ${f(`// ${1} `)} // y`; "),
        ("r = /\\/\\/[/]/; // c", "r = /\\/\\/[/]/; "),
        ("#!/usr/bin/env node // x\na // b", "#!/usr/bin/env node // x\na "),
        ("a = b / c / d /* e\n*/", "a = b / c / d \n"),
        ("s = '//'; t = \"/*\";", "s = '//'; t = \"/*\";"),
        ("`${ {a: 1}.a } // in`", "`${ {a: 1}.a } // in`"),
    ],
)
def test_strip_js(text, want):
    assert T.strip_js_text(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a/*'\"`${}\n\\ ", max_size=60))
def test_strip_js_keeps_lines_and_never_grows(text):
    out = T.strip_js_text(text)
    assert len(out) <= len(text) and out.count("\n") == text.count("\n")


def test_masks_and_samples(spark):
    assert one(spark, "id 1234567 and 12345", T.mask_digits) == "id 1000000 and 12345"
    assert one(spark, "'010-1234' 1-2", lambda c: T.star_hyphens(c)) == "'010*1234' 1-2"
    assert one(spark, "a\nEXEC SQL SELECT 1\nFROM t;\nb", T.blank_embedded_sql) == "a\n\n\nb"
    assert one(spark, "\n".join("abcdefgh"), lambda c: T.head_tail(c, 6, 2, 2)) == "a\nb\n... 4 lines omitted ...\ng\nh"


def test_function_spans():
    text = "int f(int a)\n{\n  if (a) {\n  }\n}\nint g(void);\nstatic void h()\n{\n  s = \"}\"; // }\n}\nint broken(int x)\n{\n"
    assert [s[:3] for s in X.spans_of(text)] == [("f", 1, 5), ("h", 7, 10)]
    assert [s[:3] for s in X.spans_of("function a() {\n}\nx.y = function () {\n}", "javascript")] == [("a", 1, 2), ("x.y", 3, 4)]


def test_regions():
    text = "EXEC SQL BEGIN DECLARE SECTION;\n  char name[20];\n  int no;\nEXEC SQL END DECLARE SECTION;\nvoid f() {\nEXEC SQL WHENEVER SQLERROR GOTO e;\nEXEC SQL SELECT a\n  INTO :name:ind FROM t;\nEXEC SQL WHENEVER NOT FOUND CONTINUE;\nEXEC SQL UPDATE t SET a = :no;\n if (sqlca.sqlcode) x();\n}\nEXEC SQL FETCH c"
    blocks, segments, declared = X.regions_of(text)
    assert [(b["kind"], b["line_start"], b["line_end"], b["host_vars"], b["indicators"], b["has_sqlca_check"]) for b in blocks] == [("SELECT", 7, 8, ["name"], ["ind"], True), ("UPDATE", 10, 10, ["no"], [], True)]
    assert blocks[0]["whenever"] and blocks[1]["whenever"] is None
    assert [(d["name"], d["c_type"]) for d in declared] == [("name", "char[20]"), ("no", "int")]
    assert segments == [{"line_start": 5, "line_end": 13, "func_name": "f", "error_path": True}]  # short islands join, with GOTO between
    assert [b["func_name"] for b in blocks] == ["f", "f"]


def test_segments_end_with_their_function_and_know_ways_out():
    text = "int f()\n{\nEXEC SQL COMMIT;\n a = 1;\n}\nint g()\n{\nEXEC SQL UPDATE t SET a = 1;\n if (sqlca.sqlcode) return 1;\n}"
    blocks, segments, _ = X.regions_of(text)
    assert segments == [{"line_start": 1, "line_end": 7, "func_name": "f", "error_path": False}, {"line_start": 9, "line_end": 10, "func_name": "g", "error_path": True}]
    assert [(b["func_name"], b["has_sqlca_check"]) for b in blocks] == [("f", True), ("g", True)]


def test_next_segment_is_of_the_same_function(spark):
    files = spark.createDataFrame([(1, "int f()\n{\n a;\n b;\n c;\nEXEC SQL UPDATE t SET a = 1;\n}\nint g()\n{\n a;\n b;\nEXEC SQL UPDATE t SET a = 1;\n x = sqlca.sqlcode;\n}")], "file_id long, content string")
    parsed = X.regions(files)
    blocks, segments = X.sql_blocks(parsed), X.c_segments(parsed)
    assert {r["block_no"]: (r["segment_start"], r["segment_end"]) for r in E.next_segment(blocks, segments).collect()} == {1: (7, 11), 2: (13, 14)}
    assert [(r["line_no"], r["line_end"]) for r in E.no_error_path(blocks, segments).orderBy("line_no").collect()] == [(6, 11), (12, 14)]  # a check in the next 200 characters counts, whatever function it is in


def test_exit_codes(spark):
    issues = spark.createDataFrame([(1, "critical")], "file_id long, severity string")
    of = lambda rows, found=issues: I.overall_risk(spark.createDataFrame(rows, "file_id long, error string, file_error string"), found).first()
    assert (of([(1, None, None)])["exit_code"], of([(1, None, None)])["risk"]) == (1, "CRITICAL")
    assert of([(1, "x", None)])["exit_code"] == 3 and of([(1, None, "missing")], issues.where("false"))["exit_code"] == 2
    assert of([(1, None, None), (2, None, "missing")], issues.where("false"))["exit_code"] == 0


def test_unmatched_parens(spark):
    rows = spark.createDataFrame([(1, "SELECT (a\nFROM \"it's ( x\" -- (\n/* ( */ '('\n)) ("), (2, "()"), (3, None), (4, "")], "file_id long, content string")
    assert sorted(map(tuple, Q.unmatched_parens(rows).collect())) == [(1, "(", 4), (1, ")", 4)]


def test_levels_of_a_chain_with_a_cycle_behind_it(spark):
    from sparkloupe.sources.files import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(20, 21), (21, 20), (22, 20)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(9), 20, 21, 22]], "node long")
    got = {r["node"]: (r["level"], r["cyclic"]) for r in I.topological_levels(nodes, edges).collect()}
    assert got == {i: (8 - i, False) for i in range(9)} | {i: (9, True) for i in (20, 21, 22)}


def test_report_of_files_with_and_without_issues(spark):
    files = spark.createDataFrame([(1, "a|b.c", "c", 5, "/* Module */", None), (2, "d.sql", "sql", 0, None, None), (3, "x.md", None, 1, "", "e")], "file_id long, path string, language string, line_count long, first_line string, error string")
    issues = spark.createDataFrame([(1, 1, "PC-001", "high", "security", "A | b", None, 0, 0, "llm", "", None)], "file_id long, seq long, issue_id string, severity string, category string, title string, description string, line_start long, line_end long, source string, before string, after string")
    got = {r["file_id"]: r["markdown"] for r in R.markdown(files, issues).collect()}
    assert set(got) == {1, 2, 3} and all(t.count("\n## ") == 7 for t in got.values())
    assert "| HIGH | PC-001 | A \\| b | security | llm | [링크](#high-pc-001-a-b) |" in got[1] and "- **위치**: `a|b.c`" in got[1] and "설명" not in got[1]
    assert "Module 배포" in got[1] and "> 이슈 없음" in got[2] and "분석 불가" in got[3]
    import json

    docs = {r["file_id"]: [json.loads(r[c]) for c in ("issue_list", "checklist", "summary", "deployment_checklist")] for r in R.json_documents(files, issues).collect()}
    assert docs[1][0]["total_issues"] == 1 and docs[2][1] == {"total_checks": 0, "items": []} and docs[3][3] == {"total_items": 0, "sections": []}


def test_greedy_anchors_go_by_the_first_member(spark):
    rows = [(1, s, "c", line, "high", "t", "d", "llm") for s, line in ((1, 1), (2, 4), (3, 7), (4, 2))]
    df = spark.createDataFrame(rows, "file_id long, seq long, category string, line_start long, severity string, title string, description string, source string")
    assert {r["seq"]: r["anchor_seq"] for r in I.anchors(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_risk_by_file(spark):
    issues = spark.createDataFrame([(1, "critical"), (2, "high"), (2, "high"), (2, "high"), (3, "high"), (5, "critical")], "file_id long, severity string")
    results = spark.createDataFrame([(i, "x" if i == 5 else None) for i in range(1, 6)], "file_id long, error string")
    assert {r["file_id"]: (r["risk"], r["allowed"]) for r in I.file_risk(results, issues).collect()} == {1: ("CRITICAL", False), 2: ("HIGH", True), 3: ("MEDIUM", True), 4: ("LOW", True), 5: ("UNABLE_TO_ANALYZE", False)}


def test_plan_with_cartesian_product(spark):
    text = "| Id | Operation | Name | Rows | Cost (%CPU)|\n|  0 | SELECT STATEMENT | | 10 | 5000 (1)|\n|* 1 | MERGE JOIN CARTESIAN | | 10 | 4000 |\n|  2 | TABLE ACCESS FULL | T | 200000 | 5 |"
    points = {r["step_id"]: (r["reason"], r["severity"]) for r in Q.tuning_points(Q.plan_steps(spark.createDataFrame([(1, text)], "plan_id long, content string"))).collect()}
    assert points == {0: ("high cost", "medium"), 1: ("cartesian product", "critical"), 2: ("full table scan", "high")}


def test_pii_rules(spark):
    text = "tel 010-1234-5678, id 900101-1234567, card 1234-5678-9012-3456, mail a.b@c.org, imei 490154203237518, masked 900000-1000000, M12345678"
    got = {r["rule"]: r["value"] for r in P.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert got == {"phone": "010-1234-5678", "resident_registration": "900101-1234567", "card": "1234-5678-9012-3456", "email": "a.b@c.org", "imei": "490154203237518", "passport": "M12345678"}
    masked = one(spark, text, P.masked_text)
    assert len(masked) == len(text) and "a.b@c.org" not in masked and masked.startswith("tel *************, id")


def test_markup(spark):
    xml = '<s id="a"><dataList id="d"><column id="c" name="n"/></dataList>\n<i id="x" ev:onclick="scwin.go(1); other()" xmlns:ev="e"/><i id="x"/></s>'
    error, elements, events, columns = M.parse_markup(xml)
    assert error is None and [e["functions"] for e in events] == [["go", "other"]] and columns[0]["list_id"] == "d"
    assert M.parse_markup("<a><b></a>")[0].startswith("parse error") and M.parse_markup("<!DOCTYPE html><p/>")[0].startswith("refused")
    rows = M.parsed(spark.createDataFrame([(1, xml), (2, None)], "file_id long, content string"))
    assert [tuple(r) for r in M.duplicate_ids(rows).collect()] == [(1, "x", 2, "2,2")]


def test_js_loops_and_chunks():
    text = "for (var i = 0; i < 3; i++) {\n  for (var i = 0; i < 2; i++) {\n  }\n  setTimeout(function () { f(i); }, 1);\n}\nsetTimeout(function () { f(i); }, 1);"
    assert [(f["rule"], f["line"]) for f in M.loops_of(text)] == [("NESTED_VAR_LOOP", 2), ("VAR_CLOSURE_LOOP", 4)]
    assert M.chunks_of(["x"] * 50, [12, 24], 10, 20) == [(1, 12), (13, 24), (25, 34), (35, 50)]


def test_format_calls():
    calls = M.format_calls_of('printf("%d %s%%", a);\nsprintf(b, "%*d" " %ld", w, x, y); printf(fmt, 1); fprintf(f, "a,b(%c)", g(1, 2));')
    assert [(c["line"], c["conversions"], c["arguments"]) for c in calls] == [(1, 2, 1), (2, 2, 3), (2, 1, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.c").write_bytes("한글\r\nb".encode("cp949"))
    (tmp_path / "b.js").write_bytes(b"\xef\xbb\xbfx\n")
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["encoding"], r["line_count"], r["language"]) for r in SF.with_language(SF.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.c": ("한글\nb", "cp949", 2, "c"), "b.js": ("x\n", "utf-8-sig", 1, "javascript")}
    assert SF.split_glob("/a/b/*.c") == ("/a/b", "*.c") and SF.split_glob("*.c") == (".", "*.c")
    inc = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e")], "file string, header string")
    assert {(r["header"], r["level"]) for r in SF.include_closure(inc).where("file = 'a'").collect()} == {("b", 1), ("c", 2), ("d", 3)}
    listing = spark.createDataFrame([("x/a.c", True, True), ("y/a.c", True, True), ("input/b.c", True, True), ("z/d.txt", True, True)], "path string, is_file boolean, readable boolean")
    names = spark.createDataFrame([("a.c",), ("b.c",), ("y/a.c",), ("n.c",)], "name string")
    assert {r["name"]: (r["path"], r["error"]) for r in SF.resolve_inputs(names, listing).collect()} == {"a.c": (None, "ambiguous"), "b.c": ("input/b.c", None), "y/a.c": ("y/a.c", None), "n.c": (None, "missing")}
    asked = spark.createDataFrame([(1, "x/a.c"), (2, "x/a.c"), (3, "z/d.txt"), (4, "q.c")], "seq long, path string")
    assert {r["path"]: r["reason"] for r in SF.validate(asked, listing).collect()} == {"x/a.c": None, "z/d.txt": "unsupported extension", "q.c": "missing"}


def test_tool_outputs(spark):
    js = '[{"filePath":"a.js","messages":[{"ruleId":"r","severity":2,"message":"m","line":3},{"ruleId":"q","severity":0,"message":"n","line":4}]}]'
    assert [tuple(r) for r in TO.eslint(spark.createDataFrame([(js,)], "json string")).collect()] == [("a.js", 3, 3, "r", "error", "m")]
    raw = ["a.c:1:2: warning: bad thing [bugprone-x]", "a.c:2:3: note: no", "a.c:4:1: error: 'x.h' file not found [clang-diagnostic-error]"]
    assert [(r["line_no"], r["severity"]) for r in TO.clang_tidy(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()] == [(1, "high")]
    pcc = [(1, 1, "PCC-S-02201, bad"), (1, 2, "Semantic error at line 7, column 3"), (1, 3, "Semantic error at line 9, column 1")]
    assert [(r["line"], r["code"]) for r in TO.precompiler(spark.createDataFrame(pcc, "file_id long, line_no long, raw string")).orderBy("line").collect()] == [(7, "PCC-S-02201"), (9, None)]
    parts = [(1, 2, '{"token":"b"}'), (1, 1, '{"token":"a"}'), (1, 3, '{"choices":[{"delta":{"content":"c"}}]}'), (2, 1, '{"error":"e"}')]
    assert {r["response_id"]: (r["text"], r["error"]) for r in TO.response_text(spark.createDataFrame(parts, "response_id long, seq long, raw string")).collect()} == {1: ("abc", None), 2: ("", "e")}


def test_listing_templates_and_unknown_languages(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("d/z.c", "a.c", "b.txt"):
        (tmp_path / name).write_text("x {who}")
    assert [r["path"].rsplit("/", 1)[1] for r in SF.list_files(spark, str(tmp_path), "*.c").collect()] == ["a.c", "z.c"]
    with pytest.raises(NotADirectoryError):
        SF.list_files(spark, f"{tmp_path}/none")
    assert SF.template(f"{tmp_path}/a.c", who="y") == "x y"
    with pytest.raises(KeyError):
        SF.template(f"{tmp_path}/a.c")
    with pytest.raises(ValueError):
        S.structural_search(spark.createDataFrame([], "file_id long, line_no long, raw string"), "cobol")


def test_cdata_blocks():
    text = "<script>\n<![CDATA[ var a;\n b();\n]]></script>\n<script><![CDATA[text]]></script><script>\nvar c;</script>"
    assert M.cdata_blocks(text) == [{"xml_start": 3, "js_start": 1, "length": 2, "body": " var a;\n b();"}]
    assert M.cdata_blocks("") == []


def test_structural_search_and_grep(spark):
    lines = spark.createDataFrame([(1, 1, "  SELECT * FROM t"), (1, 2, "x")], "file_id long, line_no long, raw string")
    assert [tuple(r) for r in S.structural_search(lines, "sql", "select_star").collect()] == [(1, 1, "select_star", "SELECT *", None)]
    assert [tuple(r) for r in S.structural_search(lines, custom="(F\\w+)").collect()] == [(1, 1, "custom", "FROM", "FROM")]
    assert [tuple(r) for r in S.grep(lines, "FR").collect()] == [(1, 1, "SELECT * FROM t", "FR", 11, 13)]


def test_streams(spark, tmp_path):
    from sparkloupe.streaming.text_stream import distinct_findings, pii_stream

    spark.createDataFrame([(1, "write to a.b@c.org"), (2, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    rows = distinct_findings(pii_stream(docs).withColumn("at", F.current_timestamp()), ["doc_id", "rule"], "at")
    q = rows.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["doc_id"], r["rule"]) for r in spark.table("found").collect()] == [(1, "email")]


def test_plans(spark):
    from sparkloupe.plans import verdict

    docs = spark.createDataFrame([(1, 'token = "abcdef"'), (2, None), (3, "x")], "doc_id long, text string")
    assert {r["file_id"]: r["risk"] for r in verdict.document_verdicts(docs).collect()} == {1: "MEDIUM", 2: "UNABLE_TO_ANALYZE", 3: "LOW"}
    files = spark.createDataFrame([(1, "int f()\n{\nEXEC SQL OPEN c;\nstrcpy(a, b);\nEXEC SQL UPDATE t SET a = 1;\n}")], "file_id long, content string")
    got = {r["rule_id"] for r in verdict.embedded_sql_findings(files).collect()}
    assert got == {"SQL_CURSOR_CLOSE_MISSING", "SQL_CURSOR_FETCH_MISSING", "CROSS_CURSOR_INCOMPLETE", "UNSAFE_FUNC", "SQL_SQLCA_MISSING", "SQL_COMMIT_MISSING"}
