"""Column-expression builders shared by the text operators.

All of these are native Spark SQL expressions (regex, split, higher-order
array functions) and never leave the JVM; lambda functions are interpreted, so
an array they refer to must be bound once (``bound``), or it would be built
again for every element.  A document or a page is one row; the array functions work inside that
row, and anything that must count across rows goes through explode + groupBy.

Regex notes: Java's ``\\s`` and ``\\d`` are ASCII-only, while the reference
engine's were Unicode-aware; the classes below spell the Unicode sets out so
Spark and a RE2-based oracle see the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: the characters str.isspace() accepts, as a regex class body.
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same characters as a string.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Any other character; printable ASCII is decided by one comparison.
NON_SPACE = rf"[!-~[^{WS}]]"
# Line breaks str.splitlines() splits on.
LINE_BREAKS = r"\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
LINE_BREAK = rf"\r\n|[{LINE_BREAKS}]"
# The same characters but \n.
OTHER_BREAKS = "\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029"
# Characters that are not part of a word (word = letters, digits, underscore).
NON_WORD = r"[^\p{L}\p{N}_]+"
WORD = r"[a-z\p{L}\p{N}_]"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def each(df: DataFrame, array: str, pos: str, item: str) -> DataFrame:
    """One row for every element of the column ``array``, with its position from 0 and the other columns.

    For a plain ``posexplode`` Spark infers a filter on the array; pushed below the projection that builds the
    array, it builds every array twice.  The outer form has no such filter; its rows for empty arrays go after it.
    """
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def held(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with the column ``name``, which later expressions read and never take in: a generator of one row parts them."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def two_decimals(c: Column) -> Column:
    """A double with two decimals, rounded by its exact binary value (0.575 lies below the tie: 0.57).

    ``format_string`` rounds the shortest decimal instead.  An exact tie goes to the even digit.  From 1e13 on, where hundredths fade, and for NaN it is left to ``format_string``.
    """
    def of(x: Column) -> Column:
        a = F.abs(x)
        big = a * 134217729.0  # splits a into halves whose products with 100 are exact
        high = big - (big - a)
        product = a * 100.0
        error = (high * 100.0 - product) + (a - high) * 100.0
        n = F.floor(product)
        over = (product - n) - 0.5 + error
        up = (over > 0) | ((over == 0) & (n % 2 == 1))
        k = F.when(up, n + 1).otherwise(n)
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        whole = F.concat(sign, F.floor(k / 100).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
        return F.when(a < 1e13, whole).otherwise(F.format_string("%.2f", x))
    return bound(c.cast("double"), lambda x: F.when(x.isNotNull(), of(x)))


def strip_ws(c: Column) -> Column:
    """Trim Unicode whitespace from both ends (without characters, ``trim`` only removes spaces)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, rf"[{WS}]+", " "))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def stripped_lines(c: Column) -> Column:
    """Lines with surrounding whitespace removed, blank lines dropped."""
    # blank lines go, so a run of breaks is one break; a text with no break but \n is split without a regular expression
    other = F.contains(c, F.lit(OTHER_BREAKS[0]))
    for ch in OTHER_BREAKS[1:]:
        other = other | F.contains(c, F.lit(ch))
    return F.array_remove(F.transform(F.when(other, F.split(c, f"[{LINE_BREAKS}]+")).otherwise(F.split(c, "\n")), strip_ws), "")


def spaced_words(c: Column) -> Column:
    """What ``str.split()`` gives: maximal runs of characters that are not white space."""
    return F.regexp_extract_all(c, F.lit(f"{NON_SPACE}+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Maximal runs of word characters (what ``\\b\\w+\\b`` finds)."""
    return F.array_remove(F.split(c, NON_WORD), "")


def az_words(c: Column, min_len: int = 1, lower: bool = True, upper_ok: bool = False) -> Column:
    """Words made only of ASCII letters, at least ``min_len`` long.

    Same result as ``re.findall(r'\\b[a-z]{n,}\\b', text.lower())``: a run of
    word characters counts only when all of it is ASCII letters.
    """
    src = F.lower(c) if lower else c
    cls = "a-zA-Z" if upper_ok else "a-z"
    # every run of word characters is taken whole; those of other characters leave the group empty
    pat = rf"([{cls}]{{{min_len},}}+)(?!{WORD})|{WORD}++"
    return F.array_remove(F.regexp_extract_all(src, F.lit(pat), F.lit(1)), "")


def without(arr: Column, words) -> Column:
    """Drop the given words (an ``IN`` list, which Catalyst turns into a hash set)."""
    words = list(dict.fromkeys(words))
    return F.filter(arr, lambda t: ~t.isin(*words))


def keep_only(arr: Column, words) -> Column:
    words = list(dict.fromkeys(words))
    return F.filter(arr, lambda t: t.isin(*words))


def sentences_split(c: Column, min_len: int = 10) -> Column:
    """Split on runs of ``.!?`` and keep pieces longer than ``min_len`` once stripped."""
    return F.filter(F.split(c, r"[.!?]+"), lambda s: F.length(strip_ws(s)) > F.lit(min_len))


def title_case(c: Column) -> Column:
    """Python ``str.title()``: upper after any non-letter, lower elsewhere."""
    return bound(F.split(c, ""), lambda chars: F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i == 0) | ~F.element_at(chars, i).rlike(r"^\p{L}$"), F.upper(ch)
            ).otherwise(F.lower(ch)),
        ),
        "",
    ))


def thousands(c: Column) -> Column:
    """Integer with comma thousands separators (``f"{n:,}"``)."""
    return F.format_number(c.cast("long"), 0)


def chunk_array(arr: Column, size: int) -> Column:
    """Split an array into consecutive chunks of ``size`` (last one shorter)."""
    def chunks(a):
        starts = F.sequence(F.lit(0), F.ceil(F.size(a) / F.lit(size)).cast("int") - 1)
        return F.when(F.size(a) > 0, F.transform(starts, lambda i: F.slice(a, i * size + 1, size))) \
            .otherwise(F.array().cast("array<array<string>>"))
    return bound(arr, chunks)
