"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a versioned mask over those bits, so
applying another policy, or asking what a policy would reject without one of
its rules (an ablation), reads the ledger and never the texts again.

Only DataFrame functions, one pass, no shuffle: repeated three-word windows
are found inside the row by sorting their hashes.

Null text counts as empty (no words), repeated rows are judged each for
itself, an empty table gives an empty ledger, and other columns are ignored.
A 64-bit hash stands for each three-word window *within one document*.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind

#: Rule name -> SQL condition over the measurements under which a document fails.
#: The position is the bit; append only, so that stored ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "shouting": "n_upper > n_lower",
    "exclamations": "10 * n_exclamations > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 30 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document goes if it fails any of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(RULES))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array."""
    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = bind(ordered, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
            lambda x: x["i"])))
        # a window covers three words, or as many as lie before the next start
        return bind(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        bind(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
             .otherwise(covered(h))))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the measurements that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    worded = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
    spaces = " \t\n\x0b\x0c\r"
    row = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                         _repeat_words(w).cast("long").alias("n_repeat_words")))
    out = docs.select(
        F.col(id_col).alias("doc_id"), row.alias("_w"),
        F.length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        _without(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        bind(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _without(text, "abcdefghijklmnopqrstuvwxyz").cast("long").alias("n_lower"),
        _without(text, "!").cast("long").alias("n_exclamations"))
    return out.select("doc_id", "_w.*", *out.columns[2:])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (bit i: rule i of ``RULES`` failed)."""
    bits = " + ".join(f"CAST(IF({cond}, {1 << i}, 0) AS BIGINT)" for i, cond in enumerate(RULES.values()))
    return measure(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def apply_policy(book: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return book.withColumn(column, F.col("fail_bits").bitwiseAND(policy.mask) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy decides: documents that fail it, that fail it
    alone (kept once the rule is left out), and how many a policy without it keeps.

    The ledger is first counted by bit pattern (at most ``2 ** len(RULES)``
    groups whatever the corpus holds), then the rules are tried on the patterns.
    """
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(policy.mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    tried = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                                for i, r in enumerate(RULES) if r in policy.rules]))
    x = patterns.select("bits", "n", tried.alias("t")).select("bits", "n", "t.*")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return x.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"))


def query(docs: DataFrame) -> DataFrame:
    book = apply_policy(apply_policy(ledger(docs), BASE, "_base"), STANDARD)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("_base")).alias("base_failed"), "kept", "fail_bits")


def filter_stage(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The documents a policy keeps, with their own columns."""
    book = apply_policy(ledger(docs.select(F.struct("*").alias("_row"), F.col("text").alias("text")), "_row"), policy)
    return book.filter("kept").select("doc_id.*")


def oracle_sql() -> str:
    base = " OR ".join(f"({RULES[r]})" for r in BASE.rules)
    every = " OR ".join(f"({c})" for c in RULES.values())
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))
    chars = lambda s: f"length(text) - length(translate(text, '{s}', ''))"
    return f"""
    WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^ \\t-\\r]+') ws, string_split(text, chr(10)) ls,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) wl FROM d),
    g AS (SELECT rid, unnest(range(1, len(ws) - 1)) i, ws FROM w WHERE len(ws) >= 3),
    t AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM g),
    s AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM t) WHERE c > 1),
    r AS (SELECT rid, count(DISTINCT i + o) n FROM s, (SELECT unnest([0, 1, 2]) o) GROUP BY rid),
    m AS (SELECT doc_id, len(ws)::BIGINT n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT word_chars,
                 ({chars('#*$%&|<>')})::BIGINT n_symbols, (len(wl) - len(list_distinct(wl)))::BIGINT n_dup_lines,
                 coalesce(n, 0)::BIGINT n_repeat_words, len(ls) n_lines,
                 {chars('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} n_upper, {chars('abcdefghijklmnopqrstuvwxyz')} n_lower,
                 {chars('!')} n_exclamations FROM w LEFT JOIN r USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
           NOT ({every}) AS kept, ({bits})::BIGINT AS fail_bits FROM m"""
