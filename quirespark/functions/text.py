"""Text predicates, signals, masks and hashes as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the hash, and texts that are fewer than worth a step together, characters held at once.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 1099511628211
FEW, FNV_CHARS = 8, 4_000_000

#: Fixed values that results depend on: character ranges, word lists and patterns.
SPACE = r"[\s\x{FEFF}\x{00A0}\x{3000}]"
CJK = r"[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
SYMBOLS = r"\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{0370}-\x{03FF}\x{1D400}-\x{1D7FF}\x{2100}-\x{214F}\x{2070}-\x{209F}\x{2190}-\x{21FF}±×÷"
MATH = SYMBOLS + "=+<>{}"
MATH_WORDS = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "lg", "exp", "min", "max", "arg", "sup", "inf", "det", "dim", "lim", "mod", "gcd", "lcm", "var", "std", "relu", "sig", "sgn", "softmax")
EQUATION_NUMBER = r"\((\d{1,3}[a-z]?)\)\s*\.?\s*$"
REFERENCE_HEADING = r"(?i)^(references|bibliography|参考文献|引用文献|參考文獻)$"
ENTRY_NUMBER = r"^\s*\[(\d{1,3})\]"
REFERENCE_ENTRY = r"^\s*(\[\d{1,3}\]|\d{1,3}\.)"
ABSTRACT = r"(?i)^(abstract|摘要|概要|summary)"
CAPTION = r"(?i)^(table|tab\.?|tbl\.?|figure|fig\.?)\s*[0-9IVXivx]+[.:)]?\s"
PAGE_NUMBER = r"(?i)^(\d{1,4}|[ivxlcdm]{1,6})$"
BOLD, ITALIC = r"(?i)bold|medi|black|heavy|semibold|demi", r"(?i)ital|oblique"
MATH_FONT = r"(?i)^(CMMI|CMMIB|CMSY|CMEX|CMEXB|MTMI|MTSY|MSAM|MSBM|MTEX)"
RETRYABLE = ("network", "rate-limit", "server", "empty")
OPEN_END, CONTINUES = r"[A-Za-z0-9,;\-–—]$", r"^[a-z,;]"


def stripped(c: Column) -> Column:
    """Without outer white space. Few texts have any, and the first and last character tell; `$` stands before a last line
    break too, so those that are no white space count."""
    some = F.substring(c, 1, 1).rlike(SPACE) | F.substring(c, -1, 1).rlike(rf"{SPACE}|[\x{{0085}}\x{{2028}}\x{{2029}}]")
    return F.when(some, F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def beyond_ascii(c: Column) -> Column:
    """Whether a text has characters beyond ASCII, as those are that CJK and SYMBOLS name; told without a pattern."""
    return F.octet_length(c) > F.length(c)


def cjk_first(c: Column) -> Column:
    return beyond_ascii(c) & c.rlike("^" + CJK)


def cjk_last(c: Column) -> Column:
    return beyond_ascii(c) & c.rlike(CJK + "$")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def long_words(c: Column) -> Column:
    """Words of three letters or more that are no names of functions."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z]{3,}"), F.lit(0)), lambda w: ~F.lower(w).isin(*MATH_WORDS))).cast("long")


def signals(c: Column) -> dict[str, Column]:
    """Counts that formulas are told by."""
    return {
        "n_chars": F.length(F.regexp_replace(c, SPACE, "")).cast("long"),
        "n_math": count_of(c, rf"[{MATH}()]"),
        "n_strong": count_of(c, rf"[{MATH}]"),
        "long_words": long_words(c),
        "numbered": c.rlike(EQUATION_NUMBER),
    }


def math_ratio(c: Column) -> Column:
    """Share of mathematical symbols, ASCII ones left out, in what is not white space; 0 for none."""
    n = F.length(F.regexp_replace(c, SPACE, ""))
    return F.when(beyond_ascii(c) & (n > 0), count_of(c, rf"[{SYMBOLS}]") / n).otherwise(0.0)


def font_traits(name: Column) -> tuple[Column, Column, Column]:
    """Whether a font's name says bold, italic, and mathematical (behind the prefix of a subset); null says none."""
    name = F.coalesce(name, F.lit(""))
    return name.rlike(BOLD), name.rlike(ITALIC), F.regexp_replace(name, r"^[A-Z]{6}\+", "").rlike(MATH_FONT)


def looks_like_formula(n_chars: Column, n_strong: Column, words: Column, numbered: Column, n_lines: Column) -> Column:
    dense = lambda percent: n_strong * 100 >= n_chars * percent
    plain = (words == 0) & F.when(n_lines == 1, dense(30)).otherwise(dense(25))
    return (n_chars > 0) & (n_lines <= 8) & F.when(numbered, dense(10)).otherwise(plain)


def anchor(page: Column, text: Column) -> Column:
    """Page and the first 40 characters of the text, white space collapsed."""
    return F.concat_ws("|", page.cast("string"), F.substring(stripped(F.regexp_replace(text, rf"{SPACE}+", " ")), 1, 40))


def _fnv1a(texts: list[str | None]) -> list[str]:
    """FNV-1a of many texts in lockstep: a step takes a code unit of each that is so long; the last few go one by one."""
    raw = ["" if t is None else t for t in texts]
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in raw]
    order = sorted(range(len(raw)), key=lambda k: -len(units[k]))
    size = np.array([len(units[k]) for k in order], np.int64)
    flat = np.concatenate([units[k] for k in order]) if order else np.array([], np.uint16)
    begins = np.cumsum(size) - size
    hashes, prime = np.full(len(order), FNV_START, np.uint64), np.uint64(FNV_PRIME)
    step = 0
    while (n := int(np.searchsorted(-size, -step, "left"))) >= FEW:  # texts with more than `step` units
        hashes[:n] = (hashes[:n] ^ flat[begins[:n] + step]) * prime
        step += 1
    out = [""] * len(raw)
    for place, k in enumerate(order):
        h = int(hashes[place])
        for u in units[k][step:].tolist():
            h = ((h ^ u) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        out[k] = f"{h:016x}"
    return out


@F.pandas_udf(StringType())
def _fnv1a_series(c: pd.Series) -> pd.Series:
    texts, out, at = c.tolist(), [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < FNV_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        out += _fnv1a(texts[at:stop])
        at = stop
    return pd.Series(out, dtype=object)


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a over UTF-16 code units, as 16 hex digits; null hashes as empty. Each step needs the one before, so numpy
    takes many texts at once instead."""
    return _fnv1a_series(c)


def cache_key(provider: str, model: str, language: str, prompt: int, text: Column) -> Column:
    return F.concat_ws("|", F.lit("v1"), F.lit(provider), F.lit(model), F.lit(language), F.lit(f"p{prompt}"), fnv1a(text))


def masked(c: Column, pattern: str) -> tuple[Column, Column]:
    """The text with numbered markers for what `pattern` finds, and the pieces in order."""
    pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.split(c, pattern, -1)
    marker = lambda i: F.when(i > 0, F.concat(F.lit("[[MATH_"), (i - 1).cast("string"), F.lit("]]"))).otherwise("")
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(marker(i), p)), "")
    return joined, pieces


def unmasked(c: Column, pieces: Column) -> Column:
    """Markers replaced by their pieces, the highest number first."""
    marked = F.reverse(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.concat(F.lit("[[MATH_"), i.cast("string"), F.lit("]]")).alias("m"))))
    return F.aggregate(marked, c, lambda out, x: F.replace(out, x["m"], x["p"]))


def missing_markers(c: Column, pieces: Column) -> Column:
    return F.size(F.filter(F.transform(pieces, lambda p, i: F.concat(F.lit("[[MATH_"), i.cast("string"), F.lit("]]"))), lambda m: ~F.contains(c, m))).cast("long")


def merge_masked(tail: Column, n_tail: Column, head: Column, n_head: Column) -> Column:
    """A page's tail and the next page's head: the tail's markers go behind the head's, renumbered from the highest
    down, so that none meets another."""
    down = F.when(n_tail > 0, F.sequence(n_tail - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    name = lambda i: F.concat(F.lit("[[MATH_"), i.cast("string"), F.lit("]]"))
    return F.concat_ws(" ", F.aggregate(down, tail, lambda out, i: F.replace(out, name(i), name(i + n_head))), head)


def quality_warning(source: Column, target: Column) -> Column:
    """empty, no-cjk, short or long; null when a translation passes."""
    out, size = stripped(target), F.length(stripped(source))
    return F.when(F.length(out) == 0, "empty").when(~out.rlike(r"[\x{4E00}-\x{9FA5}]"), "no-cjk").when(size < 40, F.lit(None)).when(F.length(out) * 4 < size, "short").when(F.length(out) * 2 > size * 5, "long")


def error_kind(status: Column) -> Column:
    return F.when(status.isin(401, 403), "auth").when(status == 429, "rate-limit").when(status >= 500, "server").otherwise("bad-request")


def retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def backoff_ms(attempt: Column, base: int = 800, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    wait = F.pow(F.lit(2.0), attempt - 1) * base * (F.lit(1.0) if jitter is None else jitter)
    return wait if retry_after is None else F.coalesce(retry_after.cast("double"), wait)
