"""Issues: filters, deduplication, ranking, aggregation, verdicts and reports.

issue(file_id, seq, category, severity, title, description, line_start, line_end, source, static_rule, before, after);
`seq` is the order of emission, which ties go by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LAYER_RANK, SECONDS_OF, SEVERITY_RANK, SOURCE_RANK

#: Title words and description phrases of false positives.
FP_TITLES = ("오탐", "오판", "잘못된 진단", "false positive", "오인 진단", "잘못된 분석")
FP_PHRASES = (
    "불일치가 아닙니다", "불일치 아닙니다", "문제 없습니다", "문제가 없습니다", "정상 코드입니다", "정상 동작입니다",
    "오탐입니다", "오판입니다", "버그가 아닙니다", "버그 아닙니다", "false positive로 판단", "오탐으로 판단",
)
#: Words of issues that are noise in the frameworks at hand.
NOISE = (
    "스레드 안전", "동기화 부재", "경쟁 상태", "race condition", "mutex", "동시 접근", "스레드 안전성",
    "데이터 레이스", "동시성", "요청 간 공유", "멀티스레드", "race", "concurrent", "동기화 누락",
    "null 검증", "null 체크", "널 검증", "널 체크", "널 포인터", "유효성 검증 누락", "유효성 검사 누락",
    "방어적 프로그래밍", "null 역참조", "널 역참조", "포인터 검증", "ctx 유효성", "input 유효성",
    "안전 대안", "관례 개선", "memset_s", "가독성", "유지보수성", "네이밍",
    "전역 변수 공유", "전역 상태 공유", "전역 io 구조체", "요청 간 격리", "전역 버퍼",
    "부분적으로만 채", "부분 초기화", "미설정 필드", "정보 유출", "패딩 바이트",
    "개선 권장", "표현 개선", "향후", "가독성 향상",
    "memset 이전 경로", "선언 시 초기화 누락", "선언 시 {0} 초기화",
)
#: Groups of patterns in order; those for C are the first two, and its variables.
GROUPS = (
    ("strncpy 널 종료", ("strncpy", "널 종료", "null 종료", "strlcpy")),
    ("ix 미초기화", ("ix 변수", "ix 미초기화", "ix 선언", "지역 변수 ix")),
    ("SQLCA 미검사", ("sqlca", "sqlca 에러", "sqlca 체크 누락", "sqlca_missing", "sqlca 검사", "에러 체크 누락")),
    ("INDICATOR 누락", ("indicator", "인디케이터 누락", "indicator 변수 누락", "indicator_missing", "null 값 수신")),
    ("커서 미해제", ("cursor close 누락", "커서 close", "자원 누수", "cursor_close_missing", "커서 미해제")),
)
C_GROUPS = GROUPS[:2]
C_VARIABLES = ("svc_cnt", "currsvclist_s", "out_04", "g_chg_psbl_flag")
#: Words of complaints about bounds, and prefixes of functions that check them.
BOUNDS = ("인덱스 경계", "배열 경계", "경계값", "경계 미검증", "경계 미검사", "array bounds", "array bound", "out of bounds", "index bounds", "bounds check", "경계 검증")
SAFE_PREFIXES = ("mpfm",)
#: How a merged issue says how many others it stands for; how a description names a function.
MORE = " (외 %d곳 동일 패턴)"
FUNCTION = r"(?U)함수\s+(\w+)"
#: Rules whose findings become issues: category, title, what to do.
PROMOTED = {
    "LOOP_INIT_MISSING": ("data_integrity", "루프 내 구조체 초기화 누락", "루프 시작에 INIT2VCHAR({v}); 또는 memset(&{v}, 0, sizeof({v})); 추가"),
    "CURSOR_DUPLICATE_CLOSE": ("error_handling", "cursor 중복 close", "cursor {v}의 close 경로를 한 곳으로 통합 (조건문/break 정리하여 제어 흐름 단일화)"),
    "FORMAT_ARG_MISMATCH": ("memory_safety", "printf 포맷 지정자/인자 개수 불일치", "포맷 지정자 {f}개와 실제 인자 {a}개를 일치시키도록 정렬"),
    "FORMAT_STRUCT": ("memory_safety", "%s 포맷에 구조체 직접 전달", "구조체 전체가 아닌 문자열 멤버(.field) 접근으로 변경"),
}
#: Rules that come first where a function has more findings than are shown.
FIRST_RULES = ("UNINIT_VAR", "UNSAFE_FUNC", "MALLOC_NO_CHECK", "FORMAT_STRING", "MEMSET_SIZE_MISMATCH")
#: What a checklist says for each category: command, expected result, name.
CHECKS = {
    "memory_safety": ("grep -n {pattern} {file}", "매칭 결과 없음 (0건)", "메모리 안전성"),
    "null_safety": ("grep -n {pattern} {file}", "모든 NULL 체크 완료", "NULL 안전성"),
    "data_integrity": ("grep -n 'EXEC SQL' {file}", "모든 EXEC SQL 후 SQLCA 체크 존재", "데이터 무결성"),
    "error_handling": ("grep -n {pattern} {file}", "모든 예외 경로 처리 완료", "에러 처리"),
    "security": ("grep -n {pattern} {file}", "매칭 결과 없음 (0건)", "보안"),
    "performance": ("grep -n {pattern} {file}", "인덱스 억제 패턴 제거 완료", "성능"),
    "code_quality": ("grep -n {pattern} {file}", "코드 품질 개선 완료", "코드 품질"),
}
OTHER_CHECK = ("grep -n {pattern} {file}", "이슈 수정 완료")
#: Words of an issue and the pattern to look for, in order.
CHECK_PATTERNS = (
    ("strcpy", "strcpy"), ("sprintf", "sprintf"), ("malloc", "malloc"), ("free", "free"), ("innerHTML", "innerHTML"), ("eval", "eval("),
    ("document.write", "document.write"), ("XSS", "innerHTML\\|eval\\|document.write"), ("SQLCA", "EXEC SQL"), ("INDICATOR", "INDICATOR"),
    ("SELECT *", "SELECT \\*"), ("커서", "OPEN\\|CLOSE"), ("인덱스", "YEAR\\|MONTH\\|UPPER\\|LOWER"),
)
#: Sections of a deployment in order: title, extensions, items.
SECTIONS = {
    "screen": ("화면 배포 (xml/js)", ("xml", "js"), "SCR", ("화면 소스(xml/js) SVN 커밋 확인", "개발서버 배포 및 정상 동작 확인", "운영서버 배포 요청서 작성", "운영서버 배포 후 화면 캐시 갱신 확인", "운영서버 정상 동작 확인")),
    "tp": ("TP 배포 (.c)", ("c",), "TP", ("TP 소스(.c) SVN 커밋 확인", "개발서버 컴파일(make) 정상 완료 확인", "개발서버 TP 기동 및 테스트 확인", "운영서버 배포 요청서 작성", "운영서버 컴파일(make) 정상 완료 확인", "운영서버 TP 재기동 확인", "운영서버 정상 거래 확인")),
    "module": ("Module 배포 (.c/.h)", ("h",), "MOD", ("Module 소스(.c/.h) SVN 커밋 확인", "개발서버 컴파일(make) 정상 완료 확인", "Module 참조하는 TP 전체 재컴파일 확인", "개발서버 테스트 확인", "운영서버 배포 요청서 작성 (Module + 관련 TP)", "운영서버 컴파일(make) 정상 완료 확인", "운영서버 관련 TP 전체 재기동 확인", "운영서버 정상 거래 확인")),
    "batch": ("Batch 배포 (.pc)", ("pc",), "BAT", ("Batch 소스(.pc) SVN 커밋 확인", "개발서버 proc 프리컴파일 정상 완료 확인", "개발서버 컴파일(make) 정상 완료 확인", "개발서버 Batch 테스트 실행 확인", "운영서버 배포 요청서 작성", "운영서버 컴파일(make) 정상 완료 확인", "운영서버 Batch 스케줄 등록/변경 확인")),
    "dbio": ("DBIO 배포 (.sql)", ("sql",), "DBI", ("DBIO SQL(.sql) SVN 커밋 확인", "개발DB 스크립트 실행 확인", "개발DB 데이터 검증 확인", "운영DB 배포 요청서 작성", "운영DB 스크립트 실행 확인", "운영DB 데이터 검증 확인")),
}
#: Tokens that a review request holds beside the text, and the most it may have.
OVERHEAD, LIMIT = 3000, 100_000


def rank(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in ranks.items():
        out = F.when(F.lower(column) == name, value).otherwise(out)
    return out


def severity_rank() -> Column:
    return rank(F.col("severity"), SEVERITY_RANK)


def drop_low(issues: DataFrame) -> DataFrame:
    return issues.where(F.lower("severity") != "low")


def _any(text: Column, words) -> Column:
    """Whether the text holds one of the words: one search for all, so the text is made once."""
    return text.rlike("|".join(re.escape(w) for w in words))


def drop_false_positives(issues: DataFrame) -> DataFrame:
    """Flagged (a column false_positive, if there), or by title, by description, or by a fix that changes nothing."""
    same = (F.trim("before") != "") & (F.trim("before") == F.trim("after"))
    flag = F.col("false_positive") if "false_positive" in issues.columns else F.lit(False)
    hit = flag | _any(F.lower("title"), FP_TITLES) | _any(F.lower("description"), FP_PHRASES) | same
    return issues.where(~F.coalesce(flag, F.lit(False)) & ~F.coalesce(hit, F.lit(False)))


def drop_noise(issues: DataFrame, title_only: bool = False) -> DataFrame:
    """Noise words anywhere in the text, inside other words, too."""
    text = F.lower("title") if title_only else F.lower(F.concat_ws(" ", "title", "description"))
    return issues.where(~F.coalesce(_any(text, NOISE), F.lit(False)))


def drop_safe_bounds(issues: DataFrame, prefixes=SAFE_PREFIXES) -> DataFrame:
    """A complaint about bounds (in title or description) where a call with a safe prefix is anywhere in the issue."""
    about = F.lower(F.concat_ws(" ", "title", "description"))
    text = F.concat_ws(" ", *[c for c in ("title", "description", "before", "after", "raw_match") if c in issues.columns])
    call = F.lit(False)
    for p in prefixes:
        call = call | text.rlike(rf"(?iU)\b{re.escape(p)}\w*\s*\(")
    return issues.where(~(_any(about, BOUNDS) & call))


def _group(text: Column, groups) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(groups):
        out = F.when(_any(text, words), F.lit(name)).otherwise(out)
    return out


def _merged(rows: DataFrame, order: tuple) -> DataFrame:
    """Rows with one `_key` in a file become the most severe, the earliest on ties, whose description says how many
    more there are; rows without a key stay. `seq` counts anew within a file, by `order` over _part, _first and the
    severity."""
    rows = rows.withColumn("_one", F.coalesce("_key", F.concat(F.lit("#"), F.col("seq").cast("string"))))
    key = Window.partitionBy("file_id", "_one")
    rows = rows.withColumns({"_n": F.row_number().over(key.orderBy(severity_rank().desc(), "seq")), "_all": F.count("*").over(key), "_first": F.min("seq").over(key)}).where("_n = 1")
    said = F.when(F.col("_all") > 1, F.concat(F.coalesce("description", F.lit("")), F.format_string(MORE, F.col("_all") - 1))).otherwise(F.col("description"))
    seq = F.row_number().over(Window.partitionBy("file_id").orderBy(*order)).cast("long")
    return rows.withColumn("description", said).withColumn("seq", seq).drop("_key", "_one", "_part", "_n", "_all", "_first")


def merge_groups(issues: DataFrame, groups=GROUPS) -> DataFrame:
    """Issues of one pattern group, file and function (named in the description) become one. Merged rows come
    first, groups in order of their first issue."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    function = F.coalesce(F.nullif(F.regexp_extract("description", FUNCTION, 1), F.lit("")), F.lit("(unknown)"))
    rows = issues.withColumn("_part", _group(text, groups))
    rows = rows.withColumn("_key", F.concat("_part", F.lit(":"), function))
    return _merged(rows, (F.col("_part").isNull(), "_first"))


def c_dedup(issues: DataFrame) -> DataFrame:
    """Noise by title; issues of one group by title, then issues of one listed variable and category, become one;
    the most severe come first, then groups, variables and the rest."""
    rows = drop_noise(issues, title_only=True)
    group, variable = _group(F.lower("title"), C_GROUPS), _group(F.lower("title"), [(v, (v,)) for v in C_VARIABLES])
    key = F.when(group.isNotNull(), F.concat(F.lit("g:"), group)).when(variable.isNotNull(), F.concat(F.lit("v:"), variable, F.lit("_"), F.coalesce("category", F.lit(""))))
    rows = rows.withColumns({"_key": key, "_part": F.when(group.isNotNull(), 0).when(variable.isNotNull(), 1).otherwise(2)})
    return _merged(rows, (severity_rank().desc(), "_part", "_first"))


def anchors(issues: DataFrame, reach: int = 3) -> DataFrame:
    """(…, anchor_seq): in order of seq, an issue joins the first cluster of its file and category whose first
    member is within `reach` lines, else it starts one. A null line is line 0.

    Only the first issue of a line can start a cluster, so an ordered fold over the distinct lines of a (file, category)
    finds the clusters' first members; what it holds is bounded by the file's length, not by the issues. All issues are
    then joined to the members around their line by an equi join.
    """
    line = F.coalesce("line_start", F.lit(0)).cast("long")
    rows = issues.withColumn("_line", line)
    firsts = rows.groupBy("file_id", "category", "_line").agg(F.min("seq").alias("seq"))
    order = F.array_sort(F.collect_list(F.struct("seq", F.col("_line").alias("line"))))
    begin = F.array().cast("array<struct<seq:long,line:long>>")
    step = lambda a, x: F.when(F.exists(a, lambda c: F.abs(c["line"] - x["line"]) <= reach), a).otherwise(F.concat(a, F.array(F.struct(x["seq"].cast("long").alias("seq"), x["line"].alias("line")))))
    heads = firsts.groupBy("file_id", "category").agg(F.aggregate(order, begin, step).alias("a")).select("file_id", "category", F.explode("a").alias("a"))
    near = heads.select("file_id", "category", F.col("a.seq").alias("_head"), F.explode(F.sequence(F.col("a.line") - reach, F.col("a.line") + reach)).alias("_line"))
    within = near.groupBy("file_id", "category", "_line").agg(F.array_sort(F.collect_list("_head")).alias("_heads"))  # 2 * reach + 1 at most
    found = rows.join(within, ["file_id", "category", "_line"])
    return found.withColumn("anchor_seq", F.get(F.filter("_heads", lambda h: h <= F.col("seq")), 0)).drop("_line", "_heads")


def cross_layer_dedup(issues: DataFrame) -> DataFrame:
    """Of each cluster the issue of the best source, severity and description length, the earliest on ties."""
    w = Window.partitionBy("file_id", "category", "anchor_seq").orderBy(rank(F.col("source"), SOURCE_RANK).desc(), severity_rank().desc(), F.length("description").desc(), "seq")
    return anchors(issues).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "anchor_seq")


def keyed_dedup(issues: DataFrame) -> DataFrame:
    """Key (file, line, rule or title's first 40); static issues win, then the earliest; the place is the key's first."""
    key = Window.partitionBy("file_id", "line_start", F.coalesce("static_rule", F.substring("title", 1, 40)))
    rows = issues.withColumns({"_n": F.row_number().over(key.orderBy((F.col("source") != "static_analysis").cast("int"), "seq")), "_at": F.min("seq").over(key)})
    return rows.where("_n = 1").withColumn("seq", F.col("_at")).drop("_n", "_at")


def exact_dedup(issues: DataFrame) -> DataFrame:
    """Equal (file, lines, category, title) once, the earliest."""
    w = Window.partitionBy("file_id", "line_start", "line_end", "category", "title").orderBy("seq")
    return issues.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def renumber(issues: DataFrame, prefix: str = "PC") -> DataFrame:
    """Prefix-nnn within a file, by severity and then order."""
    w = Window.partitionBy("file_id").orderBy(severity_rank().desc(), "seq")
    return issues.withColumn("issue_id", F.format_string(f"{prefix}-%03d", F.row_number().over(w)))


def promote(findings: DataFrame, prefix: str = "PC-S", tool: str = "proc_heuristic") -> DataFrame:
    """findings(file_id, seq, rule_id, severity, variable, line_no, all_lines, format_count, arg_count, content,
    description) of the listed rules as issues, numbered within a file; the last of all lines ends the place."""
    rows = findings.where(F.col("rule_id").isin(*PROMOTED))
    of = lambda i: _case(F.col("rule_id"), {r: v[i] for r, v in PROMOTED.items()})
    after = of(2)
    for mark, value in (("{v}", F.coalesce(F.nullif("variable", F.lit("")), F.lit("<var>"))), ("{f}", F.coalesce(F.col("format_count").cast("string"), F.lit("?"))), ("{a}", F.coalesce(F.col("arg_count").cast("string"), F.lit("?")))):
        after = F.replace(after, F.lit(mark), value)
    title = F.concat(of(1), F.when(F.coalesce("variable", F.lit("")) != "", F.concat(F.lit(" ("), "variable", F.lit(")"))).otherwise(F.lit("")))
    before = F.coalesce(F.nullif(F.left(F.col("content"), F.lit(120)), F.lit("")), F.lit("(원본 코드 라인)"))
    number = F.format_string(f"{prefix}-%03d", F.row_number().over(Window.partitionBy("file_id").orderBy("seq")))
    return rows.select("file_id", "seq", number.alias("issue_id"), of(0).alias("category"), "severity", title.alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.col("line_no").alias("line_start"), F.coalesce(F.array_max("all_lines"), "line_no").alias("line_end"), before.alias("before"), after.alias("after"), F.lit("static_analysis").alias("source"), F.lit(tool).alias("static_tool"), F.col("rule_id").alias("static_rule"))


def _case(column: Column, values: dict, default: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if default is None else default
    for name, value in values.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def top_findings(findings: DataFrame, k: int = 15, least: int = 20) -> DataFrame:
    """By severity and layer; at most k for each function of a file with over `least` findings, with the number of
    all. Findings outside functions are a group of their own."""
    layer = rank(F.col("source_layer"), LAYER_RANK) if "source_layer" in findings.columns else F.lit(0)
    key = Window.partitionBy("file_id", F.coalesce("func_name", F.lit("(global)")))
    rows = findings.withColumns({"position": F.row_number().over(key.orderBy(severity_rank().desc(), layer.desc(), "seq")).cast("long"), "all_of_func": F.count("*").over(key)})
    many = findings.groupBy("file_id").agg(F.count("*").alias("_n"))
    return rows.join(many, "file_id").where((F.col("position") <= k) | (F.col("_n") <= least)).drop("_n")


def function_findings(findings: DataFrame, k: int = 10, first=()) -> DataFrame:
    """The first k findings of each function, those of the rules in `first` before the others, with the number of all
    and of those that aren't shown. k = 15 and FIRST_RULES give the grouped warnings."""
    key = Window.partitionBy("file_id", "func_name")
    later = (~F.col("rule_id").isin(*first)).cast("int") if first else F.lit(0)
    rows = findings.withColumn("func_name", F.coalesce("func_name", F.lit("(global)")))
    rows = rows.withColumns({"position": F.row_number().over(key.orderBy(later, "seq")).cast("long"), "n": F.count("*").over(key)})
    return rows.withColumn("more", F.greatest(F.col("n") - k, F.lit(0))).where(F.col("position") <= k)


def global_order(issues: DataFrame) -> DataFrame:
    """Position by severity, file and seq. A range-partitioned sort is written; its partitions' sizes, a row each,
    give the numbers, so that no task holds all rows."""
    done = issues.orderBy(severity_rank().desc(), "file_id", "seq").withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    sizes = done.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    rows = done.withColumn("_part", F.shiftright("_id", 33)).join(before, "_part")
    return rows.withColumn("position", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")


def merge(issues: DataFrame) -> DataFrame:
    """False positives, noise, groups, cross-layer duplicates, numbers."""
    return renumber(cross_layer_dedup(merge_groups(drop_noise(drop_false_positives(issues)))))


def merge_fallback(issues: DataFrame) -> DataFrame:
    """As merge, without the false-positive and cross-layer steps."""
    return renumber(merge_groups(drop_noise(issues)))


def severity_histogram(issues: DataFrame) -> DataFrame:
    """A1: zero-filled counts."""
    return issues.agg(*[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITY_RANK])


def summary(issues: DataFrame, *dimensions: str) -> DataFrame:
    """A2: one pass by grouping sets: (dimension, value, n) for each dimension and the total."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    rows = issues.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(dimensions)) - 1
    name, value = F.lit("total"), F.lit("")
    for i, d in enumerate(dimensions):
        mine = F.col("g") == (full ^ (1 << (len(dimensions) - 1 - i)))
        name, value = F.when(mine, F.lit(d)).otherwise(name), F.when(mine, F.col(d).cast("string")).otherwise(value)
    return rows.select(name.alias("dimension"), F.coalesce(value, F.lit("(null)")).alias("value"), "n")


def verdict(critical: Column, high: Column, error: Column) -> Column:
    return F.when(error, "UNABLE_TO_ANALYZE").when(critical > 0, "CRITICAL").when(high >= 3, "HIGH").when(high >= 1, "MEDIUM").otherwise("LOW")


def file_risk(results: DataFrame, issues: DataFrame) -> DataFrame:
    """A4: results(file_id, error) each with its verdict; a file without issues is LOW; a failed one has zero counts."""
    counts = issues.groupBy("file_id").agg(*[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITY_RANK])
    rows = results.join(counts, "file_id", "left")
    failed = F.col("error").isNotNull()
    cols = {s: F.when(failed, F.lit(0)).otherwise(F.coalesce(s, F.lit(0))).cast("long") for s in SEVERITY_RANK}
    rows = rows.withColumns(cols)
    risk = verdict(F.col("critical"), F.col("high"), failed)
    return rows.select("file_id", *SEVERITY_RANK, risk.alias("risk"), (~risk.isin("UNABLE_TO_ANALYZE", "CRITICAL")).alias("allowed"))


def overall_risk(results: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: counts, verdict and exit code. results(file_id, error) has the files analysed; rows with a
    `file_error` are files that weren't. 2: nothing but such files; 3: an analysis failed; 1: something critical."""
    c = issues.agg(F.count("*").alias("_issues"), *[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITY_RANK])
    bad = F.col("file_error").isNotNull() if "file_error" in results.columns else F.lit(False)
    e = results.agg(F.count_if(F.col("error").isNotNull() & ~bad).alias("errors"), F.count_if(bad).alias("file_errors"), F.count("*").alias("files"))
    rows = c.crossJoin(e)  # one row each
    nothing = (F.col("file_errors") > 0) & (F.col("file_errors") == F.col("files")) & (F.col("_issues") == 0)
    code = F.when(nothing, 2).when(F.col("errors") > 0, 3).when(F.col("critical") > 0, 1).otherwise(0)
    return rows.select("files", "errors", *SEVERITY_RANK, verdict(F.col("critical"), F.col("high"), F.col("errors") > 0).alias("risk"), code.alias("exit_code"))


def blocking(issues: DataFrame) -> DataFrame:
    """A3: the issues that block a deployment: the critical ones, a row each."""
    return issues.where(F.lower("severity") == "critical").select("file_id", "issue_id")


def _quoted(text: Column) -> Column:
    """As a shell takes it for one word."""
    return F.when(text.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def checklist(issues: DataFrame) -> DataFrame:
    """Critical and high issues by (category, file), `path` being the file's: count, ids, highest severity, the first
    title, and by the first issue's text the pattern and command to check with. `first_seq` has the order of the groups;
    critical ones come before high ones."""
    rows = issues.where(F.lower("severity").isin("critical", "high"))
    text = F.lower(F.concat_ws(" ", "title", "description"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "issue_id"))), lambda x: x["issue_id"])
    rows = rows.groupBy("category", "file_id", "path").agg(F.count("*").alias("n"), ids.alias("related"), F.max_by(F.lower("severity"), severity_rank()).alias("severity"), F.min_by("title", "seq").alias("first_title"), F.min_by(text, "seq").alias("_text"), F.min("seq").alias("first_seq"))
    pattern = F.lit("TODO")
    for word, look in reversed(CHECK_PATTERNS):
        pattern = F.when(F.contains(F.col("_text"), F.lit(word.lower())), F.lit(look)).otherwise(pattern)
    category = F.col("category")
    of = lambda i, other: _case(category, {c: v[i] for c, v in CHECKS.items()}, other)
    command = F.replace(F.replace(of(0, F.lit(OTHER_CHECK[0])), F.lit("{pattern}"), _quoted(pattern)), F.lit("{file}"), _quoted(F.col("path")))
    said = F.concat(F.lit("모든 "), of(2, category), F.lit(" 이슈 수정 완료 ("), "path", F.lit(")"))
    return rows.select("category", "file_id", "path", "n", "related", "severity", "first_title", "first_seq", pattern.alias("pattern"), command.alias("command"), of(1, F.lit(OTHER_CHECK[1])).alias("expected"), said.alias("description"))


def deployment_section(path: Column, first_line: Column) -> Column:
    """The section of a file, null for none; a .c file is a module if its first line is a comment that says so and
    not that it is a service."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, (_, extensions, _, _) in SECTIONS.items():
        out = F.when(ext.isin(*extensions), F.lit(name)).otherwise(out)
    line = F.trim(first_line)
    module = line.rlike(r"^(/\*|//)") & ~F.contains(F.upper(line), F.lit("SERVICE")) & F.contains(F.lower(line), F.lit("module"))
    return F.when((ext == "c") & module, F.lit("module")).otherwise(out)


def deployment_sections(files: DataFrame) -> DataFrame:
    """files(path, first_line) by section, in the sections' order."""
    rows = files.withColumn("section", deployment_section(F.col("path"), F.col("first_line"))).where("section is not null")
    position = _case(F.col("section"), {s: str(i) for i, s in enumerate(SECTIONS)}).cast("int")
    return rows.groupBy("section").agg(F.count("*").alias("files")).withColumn("position", position)


def deployment_items(sections: DataFrame) -> DataFrame:
    """sections(section, ...) with each section's items: (..., title, item_no, item_id, item)."""
    item = lambda prefix, items: F.array(*[F.struct(F.lit(i + 1).cast("long").alias("item_no"), F.lit(f"{prefix}-{i + 1:02d}").alias("item_id"), F.lit(x).alias("item")) for i, x in enumerate(items)])
    every = F.when(F.lit(False), item("", ("",)))
    for name, (_, _, prefix, items) in SECTIONS.items():
        every = F.when(F.col("section") == name, item(prefix, items)).otherwise(every)
    title = _case(F.col("section"), {s: v[0] for s, v in SECTIONS.items()})
    return sections.select("*", title.alias("title"), F.inline(every))


def estimated_seconds(files: DataFrame) -> DataFrame:
    """Files, lines and the estimate by language, with the total."""
    seconds = F.lit(0)
    for language, n in SECONDS_OF.items():
        seconds = F.when(F.col("language") == language, n).otherwise(seconds)
    return files.withColumn("s", seconds).rollup("language").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"), F.sum("s").cast("long").alias("seconds")).withColumn("language", F.coalesce("language", F.lit("(all)")))


def routing(files: DataFrame, spans: DataFrame, ratio: float = 5.0) -> DataFrame:
    """files(file_id, content) that are too long for one request, or whose longest function is over `ratio` times
    its upper-median one, are analysed function by function; those with fewer than two functions aren't, else."""
    sizes = spans.groupBy("file_id").agg(F.array_sort(F.collect_list("line_count")).alias("s"))
    longest, median = F.element_at("s", -1), F.get("s", F.floor(F.size("s") / 2).cast("int"))
    tokens = F.floor(F.length("content") / 3)
    rows = files.select("file_id", tokens.cast("long").alias("tokens")).join(sizes, "file_id", "left")
    uneven = (F.size("s") >= 2) & (median > 0) & (longest / median > ratio)
    route = F.when((F.col("tokens") + OVERHEAD > LIMIT) | F.coalesce(uneven, F.lit(False)), "per_function").otherwise("single")
    return rows.select("file_id", "tokens", longest.alias("longest"), median.alias("median"), route.alias("route"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H2, H3: (node, level, cyclic) of edges(src, dst), src depending on dst: level 0 depends on nothing. Each round is
    an anti join and a semi join, and rounds go on until no node is ready, so their number is the depth of the graph;
    nodes left then are on or behind a cycle and come last."""
    left, out, level = nodes.select("node").distinct(), None, 0
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    while True:
        waiting = edges.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = left.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if ready.isEmpty():
            break
        out = ready if out is None else out.union(ready)
        left, level = left.join(ready.select("node"), "node", "left_anti").checkpoint(), level + 1
    rest = left.select("node", F.lit(level).alias("level"), F.lit(True).alias("cyclic"))
    return rest if out is None else out.withColumn("cyclic", F.lit(False)).union(rest)
