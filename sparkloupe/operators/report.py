"""Reports: issue cards, and for each file a Markdown document of eight sections and four JSON documents, as columns
that any sink can write.

Inputs: issues(file_id, seq, issue_id, severity, category, title, description, line_start, line_end, source, before,
after, and fix_description if there), numbered already; files(file_id, path, language, line_count, first_line, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEVERITY_RANK
from . import issues as I

#: Names of risks, and the language that a code block names.
RISKS = {"CRITICAL": "CRITICAL (즉시 조치 필요)", "HIGH": "HIGH (조치 권고)", "MEDIUM": "MEDIUM (검토 권고)", "LOW": "LOW (양호)", "UNABLE_TO_ANALYZE": "분석 불가"}
BLOCKS = {"javascript": "javascript", "c": "c", "proc": "c", "sql": "sql", "xml": "xml"}
_RULE = ("---", "")
_FIELDS = ("issue_id", "severity", "category", "title", "description", "line_start", "line_end", "source", "before", "after", "fix_description")


def cell(text: Column) -> Column:
    """A text as a table's cell."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def slug(heading: Column) -> Column:
    """The anchor of a heading: lower case, marks dropped, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"(?U)[^\w\s\-]", ""), r"(?U)\s+", "-")


def _array(*items) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])


def _some(condition: Column, *items) -> Column:
    return F.when(condition, _array(*items)).otherwise(F.array().cast("array<string>"))


def _category(category: Column) -> Column:
    return I._case(category, {c: v[2] for c, v in I.CHECKS.items()}, category)


def _heading(i: Column) -> Column:
    return F.concat(F.lit("["), F.upper(i["severity"]), F.lit("] "), i["issue_id"], F.lit(" "), i["title"])


def toc_line(i: Column) -> Column:
    """A row of the table of contents, linked to the card's heading."""
    cells = [F.upper(i["severity"]), *[cell(i[c]) for c in ("issue_id", "title", "category", "source")], F.concat(F.lit("[링크](#"), slug(_heading(i)), F.lit(")"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def card_lines(i: Column, path: Column, block: Column) -> Column:
    """The lines of an issue's card; parts without a text are left out, and so is a line that isn't known."""
    there = lambda c: F.coalesce(i[c], F.lit("")) != ""
    first, last = F.coalesce(i["line_start"], F.lit(0)), F.coalesce(i["line_end"], F.lit(0))
    place = F.when(first <= 0, path).when((last > 0) & (last != first), F.concat(path, F.lit(":"), first.cast("string"), F.lit("~"), last.cast("string"))).otherwise(F.concat(path, F.lit(":"), first.cast("string")))
    fence = F.concat(F.lit("```"), block)
    return F.concat(
        _array(F.concat(F.lit("### "), _heading(i)), F.concat(F.lit("- **위치**: `"), place, F.lit("`")), F.concat(F.lit("- **분류**: `"), i["category"], F.lit("` ("), _category(i["category"]), F.lit(")")), F.concat(F.lit("- **출처**: "), i["source"]), ""),
        _some(there("description"), "#### 설명", i["description"], ""),
        _some(there("before"), "#### 수정 전", fence, i["before"], "```", ""),
        _some(there("after"), "#### 수정 후", fence, i["after"], "```", ""),
        _some(there("fix_description"), "#### 조치 가이드", i["fix_description"], ""),
    )


def cards(files: DataFrame, issues: DataFrame) -> DataFrame:
    """O2: (file_id, issue_id, anchor, toc, card) for each issue."""
    rows = _filled(issues).join(files.select("file_id", "path", "language"), "file_id")
    i = F.struct(*_FIELDS)
    return rows.select("file_id", "issue_id", slug(_heading(i)).alias("anchor"), toc_line(i).alias("toc"), F.array_join(card_lines(i, F.col("path"), I._case(F.col("language"), BLOCKS, F.lit(""))), "\n").alias("card"))


def _filled(issues: DataFrame) -> DataFrame:
    return issues if "fix_description" in issues.columns else issues.withColumn("fix_description", F.lit(None).cast("string"))


def _gathered(files: DataFrame, issues: DataFrame) -> DataFrame:
    """files with their issues by severity, their counts, verdict, categories, checks and deployment section. A file's
    issues come together, as its document does; files are bounded, corpora aren't."""
    place = issues.join(files.select("file_id", "path"), "file_id")
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("first_seq", "category"))
    checks = I.checklist(place).withColumn("no", number)
    urgent = (F.col("severity") != "critical").cast("int").alias("later")
    checks = checks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(urgent, "no", "category", "severity", "description", "related", "command", "expected"))).alias("checks"))
    kinds = issues.groupBy("file_id", "category").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "category"))).alias("kinds"))
    every = _filled(issues).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-I.severity_rank()).alias("_less"), "seq", *_FIELDS))).alias("issues"))
    rows = I.file_risk(files.select("file_id", "error"), issues).join(files.drop("error"), "file_id")
    rows = rows.join(every, "file_id", "left").join(checks, "file_id", "left").join(kinds, "file_id", "left")
    return rows.withColumn("section", I.deployment_section(F.col("path"), F.col("first_line")))


def _duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%.0f초", F.bround(seconds, 0))).otherwise(F.format_string("%d분 %d초", F.floor(whole / 60), whole % 60))


def _stamp(at: Column) -> Column:
    return F.when(F.coalesce(at, F.lit("")) == "", F.lit("(알 수 없음)")).otherwise(F.left(F.regexp_replace(F.substring_index(F.replace(at, F.lit("T"), F.lit(" ")), ".", 1), "Z$", ""), F.lit(16)))


def _summary_lines(seconds: Column, tokens: Column) -> Column:
    total = F.coalesce(F.size("issues"), F.lit(0))
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    allowed = F.when(F.col("allowed"), "가능").otherwise("불가")
    risk = I._case(F.col("risk"), RISKS, F.col("risk"))
    text = lambda c: F.col(c).cast("string")
    there = F.col("kinds").isNotNull()
    kind = lambda k: F.concat(F.lit("| "), _category(k["category"]), F.lit(" (`"), k["category"], F.lit("`) | "), (-k["less"]).cast("string"), F.lit(" |"))
    return F.concat(
        _array("## 분석 요약", "", "| 항목 | 값 |", "|------|-----|", row("총 이슈 수", total.cast("string")), *[row(s.capitalize(), text(s)) for s in SEVERITY_RANK]),
        _array(row("배포 위험도 (전체)", risk), row("배포 가능 여부 (전체)", allowed), row("분석 시간", _duration(seconds)), row("LLM 토큰", F.format_number(tokens, 0)), ""),
        _array("### 파일별 배포 판정", "", "| 파일 | Critical | High | Medium | 배포 위험도 | 배포 |", "|------|---------|------|--------|-----------|-----|"),
        _array(F.concat(F.lit("| `"), cell(F.col("path")), F.lit("` | "), F.concat_ws(" | ", text("critical"), text("high"), text("medium"), risk, allowed), F.lit(" |")), ""),
        F.when(there, F.concat(_array("### 카테고리별 이슈", "", "| 카테고리 | 건수 |", "|----------|------|"), F.transform("kinds", kind), _array(""))).otherwise(F.array().cast("array<string>")),
        _some(there, "### 언어별 이슈", "", "| 언어 | 건수 |", "|------|------|", F.concat(F.lit("| "), F.upper("language"), F.lit(" | "), total.cast("string"), F.lit(" |")), ""),
        _some(there, "### 파일별 이슈", "", "| 파일 | 건수 |", "|------|------|", F.concat(F.lit("| `"), F.col("path"), F.lit("` | "), total.cast("string"), F.lit(" |")), ""),
        _array(*_RULE),
    )


def _cards_of(chosen: Column, title: str, none: str) -> Column:
    """A section of cards."""
    block = I._case(F.col("language"), BLOCKS, F.lit(""))
    every = F.flatten(F.transform(chosen, lambda i: F.concat(card_lines(i, F.col("path"), block), _array(""))))
    return F.concat(_array(f"## {title}", ""), F.when(F.coalesce(F.size(chosen), F.lit(0)) > 0, every).otherwise(_array(f"> {none}", "")), _array(*_RULE))


def _deployment_lines() -> Column:
    out = _array("> 해당 없음")
    for name, (title, _, prefix, items) in I.SECTIONS.items():
        lines = [f"- [ ] {prefix}-{i + 1:02d}: {x}" for i, x in enumerate(items)]
        out = F.when(F.col("section") == name, _array(f"### {title}", "", F.concat(F.lit("- 파일: `"), "path", F.lit("`")), "", *lines)).otherwise(out)
    return F.concat(_array("## 배포 체크리스트", ""), out, _array("", *_RULE))


def _check_lines(c: Column) -> Column:
    head = F.concat(F.lit("- [ ] **["), F.upper(c["severity"]), F.lit("]** CHECK-"), c["no"].cast("string"), F.lit(": "), c["description"])
    return _array(head, F.concat(F.lit("  - 관련 이슈: "), F.array_join(c["related"], ", ")), F.concat(F.lit("  - 검증: `"), c["command"], F.lit("`")), F.concat(F.lit("  - 기대 결과: "), c["expected"]))


def markdown(files: DataFrame, issues: DataFrame, title: str = "분석 리포트", session: str = "", at: str = "", seconds: float = 0.0, tokens: int = 0) -> DataFrame:
    """O1: (file_id, markdown): title, summary, contents, critical and high issues, all issues, checklist, deployment
    checklist, metadata. A file without issues has a document, too; a null description or fix leaves its part out."""
    none = F.array().cast("array<string>")
    rows = _gathered(files, issues)
    have = F.coalesce(F.size("issues"), F.lit(0)) > 0
    urgent = F.filter("issues", lambda i: F.lower(i["severity"]).isin("critical", "high"))
    toc = F.when(have, F.concat(_array("| 레벨 | 순번 | 제목 | 분류 | 출처 | 앵커 |", "|---|---|---|---|---|---|"), F.transform("issues", toc_line))).otherwise(_array("> 이슈 없음"))
    checks = F.when(F.col("checks").isNotNull(), F.flatten(F.transform("checks", _check_lines))).otherwise(_array("> 해당 없음"))
    lines = F.concat(
        _array(f"# {title}", "", F.concat(F.lit("- **분석 시각**: "), _stamp(F.lit(at))), "- **분석 대상**:", F.concat(F.lit("  - `"), "path", F.lit("`")), "", *_RULE),
        _summary_lines(F.lit(float(seconds)), F.lit(int(tokens))),
        F.concat(_array("## 전체 이슈 목차(표)", ""), toc, _array("", *_RULE)),
        _cards_of(urgent, "핵심 이슈 (Critical / High)", "핵심 이슈 없음"),
        _cards_of(F.col("issues"), "전체 이슈 목록", "주요 이슈 없음"),
        F.concat(_array("## 검증 체크리스트", ""), checks, _array("", *_RULE)),
        _deployment_lines(),
        _array("## 메타데이터", "", f"- **세션 ID**: `{session}`", "- **분석 파일 수**: 1", F.concat(F.lit("- **총 라인 수**: "), F.format_number("line_count", 0), F.lit("줄")), ""),
    )
    return rows.select("file_id", F.array_join(F.coalesce(lines, none), "\n").alias("markdown"))


def json_documents(files: DataFrame, issues: DataFrame) -> DataFrame:
    """O3: (file_id, issue_list, checklist, summary, deployment_checklist), a JSON document each; nulls are left out."""
    rows = _gathered(files, issues)
    place = lambda i: F.struct(F.col("path").alias("file"), i["line_start"].alias("line_start"), i["line_end"].alias("line_end"))
    issue = lambda i: F.struct(*[i[c].alias(c) for c in ("issue_id", "category", "severity", "title", "description")], place(i).alias("location"), F.struct(i["before"].alias("before"), i["after"].alias("after"), i["fix_description"].alias("description")).alias("fix"), i["source"].alias("source"))
    total = F.coalesce(F.size("issues"), F.lit(0))
    check = lambda c: F.struct(F.concat(F.lit("CHECK-"), c["no"].cast("string")).alias("id"), c["category"].alias("category"), c["severity"].alias("severity"), c["description"].alias("description"), c["related"].alias("related_issues"), c["command"].alias("verification_command"), c["expected"].alias("expected_result"))
    items = F.when(F.lit(False), F.array(F.struct(F.lit("").alias("id"), F.lit("").alias("item"))))
    for name, (_, _, prefix, texts) in I.SECTIONS.items():
        items = F.when(F.col("section") == name, F.array(*[F.struct(F.lit(f"{prefix}-{i + 1:02d}").alias("id"), F.lit(x).alias("item")) for i, x in enumerate(texts)])).otherwise(items)
    title = I._case(F.col("section"), {s: v[0] for s, v in I.SECTIONS.items()})
    section = F.when(F.col("section").isNotNull(), F.array(F.struct(F.col("section").alias("section_id"), title.alias("title"), F.array("path").alias("files"), items.alias("items"))))
    counts = F.struct(*[F.col(s).alias(s) for s in SEVERITY_RANK])
    return rows.select(
        "file_id",
        F.to_json(F.struct(total.alias("total_issues"), F.coalesce(F.transform("issues", issue), F.array()).alias("issues"))).alias("issue_list"),
        F.to_json(F.struct(F.coalesce(F.size("checks"), F.lit(0)).alias("total_checks"), F.coalesce(F.transform("checks", check), F.array()).alias("items"))).alias("checklist"),
        F.to_json(F.struct(F.struct(total.alias("total"), counts.alias("by_severity")).alias("issue_summary"), F.struct(F.col("risk").alias("deployment_risk"), F.col("allowed").alias("deployment_allowed")).alias("risk_assessment"))).alias("summary"),
        F.to_json(F.struct(F.coalesce(F.size(items), F.lit(0)).alias("total_items"), F.coalesce(section, F.array()).alias("sections"))).alias("deployment_checklist"),
    )
