"""Text preprocessing as column expressions: comment stripping, blanking, masking, sampling.

A text is cut into tokens (strings, comments, the rest) by one alternation, the tokens of one kind are rewritten and
joined again. Everything stays in the JVM; only JavaScript's nested templates need an automaton (`strip_js`).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DOUBLE = r'"(?:[^"\\\n]|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]|\\.)*+'"
_BLOCK = r"/\*(?s:.*?)(?:\*/|\z)"
C_TOKENS = rf"(?s){_DOUBLE}|{_SINGLE}|//[^\n]*+|{_BLOCK}|[^\"'/]++|."
PROC_TOKENS = rf"(?s){_DOUBLE}|{_SINGLE}|//[^\n]*+|{_BLOCK}|(?i:\bEXEC\s+SQL\b)[^;]*+;?|[^\"'/E]++|."
SQL_TOKENS = rf"(?s)'(?:[^']|'')*+'|--[^\n]*+|{_BLOCK}|[^'/-]++|."
XML_TOKENS = r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|[^<]++|."
EXEC_TOKENS = r"(?is)\bEXEC\s+(?:SQL|ORACLE)\b[^;]*+;|[^E]++|."
HINT = r'^/\*\+[ A-Za-z"]'


def rewrite(text: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """The text with each token of the pattern, which must match everywhere, passed through `use`."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), use), "")


def is_comment(token: Column) -> Column:
    return (token.startswith("//") | token.startswith("/*")) & ~token.rlike(HINT)


def keep_breaks(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\r\n]", "")


def strip_c(text: Column) -> Column:
    """Comments outside strings dropped; their line breaks and optimizer hints kept."""
    return rewrite(text, C_TOKENS, lambda t: F.when(is_comment(t), keep_breaks(t)).otherwise(t))


def strip_sql(text: Column) -> Column:
    """As strip_c, with `--` comments and '' in strings; double quotes aren't strings."""
    return rewrite(text, SQL_TOKENS, lambda t: F.when(t.startswith("--") | (t.startswith("/*") & ~t.rlike(HINT)), keep_breaks(t)).otherwise(t))


def strip_proc(text: Column) -> Column:
    """strip_c, and `--` comments between EXEC SQL and its semicolon."""

    def use(t: Column) -> Column:
        return F.when(is_comment(t), keep_breaks(t)).when(t.rlike(r"(?is)^EXEC\s+SQL\b"), strip_sql(t)).otherwise(t)

    return rewrite(text, PROC_TOKENS, use)


def strip_xml(text: Column) -> Column:
    """Markup comments dropped, line breaks kept; CDATA is left alone."""
    return rewrite(text, XML_TOKENS, lambda t: F.when(t.startswith("<!--"), keep_breaks(t)).otherwise(t))


def blank_comments(text: Column) -> Column:
    """Comments become spaces of the same length; line breaks stay."""
    return rewrite(text, C_TOKENS, lambda t: F.when(t.startswith("//") | t.startswith("/*"), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t))


def blank_embedded_sql(text: Column) -> Column:
    """EXEC SQL and EXEC ORACLE statements become as many line breaks as they had."""
    return rewrite(text, EXEC_TOKENS, lambda t: F.when(t.rlike(r"(?is)^EXEC\s+(SQL|ORACLE)\b.*;$"), F.regexp_replace(t, r"[^\n]", "")).otherwise(t))


def star_hyphens(text: Column, sql: bool = False) -> Column:
    """Within string literals, digit-digit becomes digit*digit; the length stays."""
    quoted = (lambda t: t.startswith("'")) if sql else (lambda t: t.startswith('"') | t.startswith("'"))
    return rewrite(text, SQL_TOKENS if sql else C_TOKENS, lambda t: F.when(quoted(t), F.regexp_replace(t, r"(\d)-(?=\d)", "$1*")).otherwise(t))


def blank_strings(line: Column) -> Column:
    """A line without comments, its literals emptied; lines with neither a quote nor a slash are as they are."""
    bare = rewrite(line, C_TOKENS, lambda t: F.when(is_comment(t), F.lit("")).when(t.startswith('"'), F.lit('""')).when(t.startswith("'") & (F.length(t) > 1), F.lit("''")).otherwise(t))
    return F.when(line.rlike("[\"'/]"), bare).otherwise(line)


def mask_digits(text: Column, least: int = 6) -> Column:
    """Runs of `least` or more digits keep the first and become zeros after it."""
    return rewrite(text, rf"(?s)[0-9]{{{least},}}|[0-9]++|[^0-9]++", lambda t: F.when(t.rlike(rf"^[0-9]{{{least},}}$"), F.rpad(F.left(t, F.lit(1)), F.length(t), F.lit("0"))).otherwise(t))


def lines(text: Column) -> Column:
    """The lines of a text; a trailing line break starts no line."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def head_tail(text: Column, most: int = 500, head: int = 250, tail: int = 250) -> Column:
    """Texts over `most` lines: the first and last lines around a marker."""
    parts = lines(text)
    n = F.size(parts)
    cut = F.concat(F.slice(parts, 1, head), F.array(F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines omitted ..."))), F.slice(parts, n - tail + 1, F.lit(tail)))
    return F.when(n > most, F.array_join(cut, "\n")).otherwise(text)


def token_estimate(text: Column, per: int = 4) -> Column:
    return F.floor(F.length(text) / per).cast("long")


def newlines_before(text: Column, at: Column) -> Column:
    """The 1-based line of the 0-based offset."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def strip_js_text(text: str) -> str:
    """JavaScript comments dropped: a push-down automaton for nested templates, regular expressions and a shebang."""
    out: list[str] = []
    depth: list[int] = []  # open braces of each template expression
    i, n, last = 0, len(text), ""

    def quoted(i: int, end: str) -> int:
        while i < n and text[i] != end and text[i] != "\n":
            i += 2 if text[i] == "\\" else 1
        return min(n, i + 1)

    def template(i: int) -> int:
        while i < n:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                depth.append(0)
                return i + 2
            else:
                i += 1
        return n

    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
        out.append(text[:i])
    while i < n:
        c, start = text[i], i
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
            continue
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
            out.append("".join(x for x in text[start:i] if x in "\r\n"))
            continue
        if c in "\"'":
            i = quoted(i + 1, c)
        elif c == "`":
            i = template(i + 1)
        elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%~^<>"):
            i, inside = i + 1, False
            while i < n and text[i] != "\n" and (inside or text[i] != "/"):
                inside = {"[": True, "]": False}.get(text[i], inside)
                i += 2 if text[i] == "\\" else 1
            i = min(n, i + 1)
        elif c == "{" and depth:
            depth[-1] += 1
            i += 1
        elif c == "}" and depth and depth[-1] == 0:
            depth.pop()
            i = template(i + 1)
        else:
            if c == "}" and depth:
                depth[-1] -= 1
            i += 1
        out.append(text[start:i])
        last = text[i - 1] if not text[i - 1].isspace() else last
    return "".join(out)


def _strip_js(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else strip_js_text(t))


def strip_js(text: Column) -> Column:
    """strip_js_text in Arrow batches."""
    return F.pandas_udf(_strip_js, "string")(text)
