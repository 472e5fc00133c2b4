"""Column builders over texts. Patterns are written so that Java's engine and RE2 read them alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters, protected spans, headers, sign-offs.
WORD = r"[\p{L}\p{N}_]+"
WF_WORD = r"[\p{L}\p{N}_\-]+"
CONTRAST_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’\-][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
LANGUAGE_WORD = r"[A-Za-zÀ-ÿ]+"
SPELLED_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'-]{2,}"
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*(?=://)"
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"(?i)(?:https?|ftp)://[^\s<>()]+|www\.[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s<>()]*)?"
NUMERIC_BODY = r"(?:\+?\d[\d .:/()\-]{2,}\d|[A-Z]{1,8}[-/]?\d{2,}[A-Z0-9/-]*|\d{4}[-/]\d{1,2}[-/]\d{1,4})"
NUMERIC_ID = r"(?<![\p{L}\p{N}_])" + NUMERIC_BODY + r"(?![\p{L}\p{N}_])"
HEADER = r"^\s*[*_~`]{0,3}[A-Za-z][A-Za-z0-9-]{1,50}\s*:.*$"
CAPITALS = r"^[A-ZÀÁÂÃÄÅÆÇ-ÖØ-Ý]{5,}$"
SHOUTING = r"!{2,}|\?{2,}|(?:!\s*){3,}"
RUN_ON = r"[^.!?,\n]{300,}"
APOSTROPHE = r"[\p{L}\p{N}_]+['’][\p{L}\p{N}_]+"
CONTRACTION = r"^[A-Za-z]+['’](?:m|re|ve|ll|d|t|s|M|RE|VE|LL|D|T|S)$"
SPACED_MARK = r"\s+[,:;.!?]"
LOWER_START = r"[.!?]\s+[a-zà-öø-ÿ]"
GREETING = r"^\s*[A-ZÀ-Ü][^\n]{2,70}[,:][ \t]*$"
CONTACT = r"\+?\d[\d .:/()\-]{6,}"
MID_END = r"[.!?]\s+[\p{L}\p{N}_]"
def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Lower-case word tokens."""
    return matches(F.lower(_col(c)), WORD)


def n_tokens(c: Column | str) -> Column:
    return F.size(tokens(c))


def contrast_tokens(c: Column | str) -> Column:
    """Distinct lower-case words of three letters or more, in order of first sight."""
    words = F.transform(matches(c, CONTRAST_WORD), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def _folded(words: pd.Series) -> pd.Series:
    strip = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")
    return words.map(lambda w: None if w is None else w if w.isascii() else strip(w))


def fold_diacritics(c: Column | str) -> Column:
    """Letters without their marks, by decomposition; in Arrow batches, as the engine has no normal forms. For words, not
    for texts."""
    return F.pandas_udf(_folded, "string")(_col(c))


def masked(c: Column | str) -> Column:
    """Addresses, links and identifiers read as spaces."""
    out = _col(c)
    for pattern in (EMAIL, URL, NUMERIC_ID):
        out = F.regexp_replace(out, pattern, " ")
    return out


def scoring_text(c: Column | str) -> Column:
    """A text without the leading paragraphs in which every line is a header; the text itself where nothing else is left."""
    body = let(paragraphs(c), lambda p: F.array_join(without_headers(p), "\n\n"))
    return let(body, lambda b: F.when(b != "", b).otherwise(F.regexp_replace(_col(c), r"^\s+|\s+$", "")))


def without_fixture_headers(c: Column | str) -> Column:
    """A calibration text without its leading header lines and the blank lines after them; blank lines alone go too."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^(?:[ \t]*\n)?(?:[ \t]*[A-Za-z][A-Za-z0-9-]{1,50}[ \t]*:[^\n]*(?:\n|$))+(?:[ \t]*\n)*", ""), r"^\n+|\n+$", "")


def is_header(line: Column) -> Column:
    return line.rlike(HEADER)


def paragraphs(c: Column | str) -> Column:
    parts = F.transform(F.split(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def without_headers(parts: Column) -> Column:
    """Paragraphs after the leading ones in which every line is a header."""
    def rest(p: Column) -> Column:
        first = F.array_position(F.transform(p, lambda x: F.forall(lines(x), is_header)), F.lit(False))
        return let(first, lambda at: F.when(at > 0, F.slice(p, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(p), F.lit(1)))).otherwise(F.array().cast("array<string>")))

    return let(parts, rest)


def is_signoff(p: Column) -> Column:
    def judged(v: Column) -> Column:
        own, n = v["own"], v["n"]
        size, joined = F.size(own), F.array_join(own, " ")
        contact = joined.rlike(EMAIL) | joined.rlike(URL) | joined.rlike(CONTACT)
        farewell = (size <= 3) & F.get(own, 0).rlike(r"[,;:]$")
        return (size > 0) & (size <= 8) & (n <= 35) & (contact | farewell | ((size <= 4) & (n <= 18)))

    return let(F.struct(lines(p).alias("own"), n_tokens(p).alias("n")), judged)


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def error_summary(c: Column | str, limit: int = 300) -> Column:
    """A provider's error on one line, cut to ``limit`` characters."""
    text = collapse(F.coalesce(_col(c), F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def retry_after(c: Column | str, now: Column | None = None) -> Column:
    """Seconds of a Retry-After header, not below 0, given as seconds or as an HTTP date (seconds from ``now``, epoch
    seconds); NULL for what is neither."""
    x = _col(c).try_cast("double")
    date = F.regexp_extract(_col(c), r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    at = F.unix_timestamp(F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss"))).cast("double")
    x = F.coalesce(x, at - (F.unix_timestamp().cast("double") if now is None else now))
    return F.when(x < 0, 0.0).otherwise(x)


def formatted(metric: Column, value: Column) -> Column:
    """A metric's value as reports print it."""
    two = metric.endswith("_errors_per_email") | metric.isin("avg_ptbr_violations_per_email", "avg_wf_penalty_per_email")
    return (
        F.when(value.isNull(), "N/A")
        .when(metric.endswith("_pct"), F.format_string("%.1f%%", value))
        .when(metric.isin("euptvid_probability", "entity_f1"), F.format_string("%.3f", value))
        .when(metric.endswith("_ms"), F.concat(F.format_number(value, 0), F.lit(" ms")))
        .when(metric == "throughput_emails_per_min", F.concat(F.format_number(value, 1), F.lit(" emails/min")))
        .when(metric == "tokens_per_second", F.concat(F.format_number(value, 1), F.lit(" tokens/s")))
        .when(metric.startswith("cost_per_1k_emails_usd"), F.concat(F.lit("$"), F.format_number(value, 4)))
        .when(metric.isin("unknown_cost_samples", "known_cost_samples"), F.format_number(value, 0))
        .when(two, F.format_string("%.2f", value))
        .otherwise(F.format_string("%.1f", value))
    )
