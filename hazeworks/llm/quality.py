"""Quality rules as a short-circuit cascade.

``measures`` computes the counts of a text in linear or n log n time with built-in functions only. ``plan_cascade`` times every
rule and counts what it rejects on a bounded sample, then orders the rules by rejected rows per second; ``verdict`` chains them
in that order in one CASE, so a later rule is evaluated only for rows that all earlier ones let pass. The order changes the
speed, never the outcome.

Repeated 3-word windows are found inside the row: each window's hash (its upper 33 bits, window position in the lower 31) is
sorted as a long; neighbours of equal hash are candidates, and the candidates alone are sorted by their actual words, so hash
collisions cannot count.

Nulls: a null text has no words and fails the base rule, like empty and blank texts. Very long texts stay in one row but cost
n log n. Repeated rows get equal verdicts. An empty table gives an empty result. ``measures`` and ``rate_documents`` keep the input's
columns and replace those of the names in ``COLUMNS``; ``keep_documents`` gives rows as they are, so there no name of ``COLUMNS`` may
be in the input (see ``common.set_aside``).
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import SPACES, materialize, quoted, words

SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: With fewer words a text fails the base rule, as it does with a share of repeated words above BASE_REPEATED.
BASE_WORDS, BASE_REPEATED = 50, 50


@dataclass(frozen=True)
class Rule:
    """Rejects a row where ``rejects`` (over the measures and ``text``) is true. ``repeats`` says that it uses n_repeat_words, which costs most."""

    name: str
    rejects: Column
    repeats: bool = False


def default_rules(text: str = "text") -> list[Rule]:
    """Thresholds well outside what running prose shows, as rules for web text commonly set them."""
    t, n, chars = F.coalesce(F.col(text), F.lit("")), F.col("n_words"), F.col("word_chars")
    count = lambda pattern: F.length(F.regexp_replace(t, f"[^{pattern}]", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("repeated_lines", (F.col("n_dup_lines") > 3) & (F.col("n_dup_lines") * 10 > F.size(F.split(t, "\n", -1)) * 3)),
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("repeated_words", F.col("n_repeat_words") * 10 > n * 4, True),
        Rule("exclamations", (F.length(t) - F.length(F.translate(t, "!", ""))) * 5 > n),
        Rule("capitals", count("A-Z") * 2 > chars),
        Rule("digits", count("0-9") * 5 > chars * 2),
    ]


def _repeat_words(w: Column) -> Column:
    """Array of words -> sorted longs that hold hash and position of each 3-word window."""
    windows = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    packed = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(windows, packed))


def _candidates(z: Column) -> Column:
    """Positions of windows whose hash has an equal neighbour."""
    high = lambda x: F.shiftright(x, 31)
    same = lambda x, i: F.coalesce(high(x) == high(F.get(z, i + 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(z, i - 1)), F.lit(False))
    return F.filter(z, same)


def _confirmed(c: Column, w: Column) -> Column:
    """Candidates sorted by their words; (words, position) each."""
    at = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    three = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    return F.sort_array(F.transform(c, lambda x: three(at(x))))


def _starts(s: Column) -> Column:
    """Sorted positions of windows that occur twice or more."""
    key = lambda x: F.struct(x["a"], x["b"], x["c"])
    same = lambda x, i: F.coalesce(key(x) == key(F.get(s, i + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, i - 1)), F.lit(False))
    return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))


def _covered(p: Column) -> Column:
    """Words covered by windows at the sorted positions ``p``: each window adds 3, or less where the next begins earlier."""
    added = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"]


def _measured(docs: DataFrame, text: str, wanted: Column | None = None) -> DataFrame:
    """Input columns plus the measures but base_failed; n_repeat_words only where ``wanted`` (over the other measures) is true, if given.

    Each array is a column of its own projection: it is used more than once by the next, so it is computed once per row.
    """
    kept = [quoted(c) for c in docs.columns if c not in COLUMNS]
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(t, chars, "")).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Never false, but not known to the optimizer: a filter on measures would else move below and compute each array again for every use.
    unknown = F.monotonically_increasing_id() >= 0
    w, z, c, d, p, ls = (f"_{uuid.uuid4().hex}" for _ in range(6))
    cheap = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = docs.select(*kept, words(F.col(text)).alias(w), lines.alias(ls))
    rows = rows.select(
        *kept,
        w,
        F.when(unknown, F.size(w).cast("long")).alias("n_words"),
        without(SPACES).alias("word_chars"),
        (F.length(t).cast("long") - without(SYMBOLS)).alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    )
    if wanted is not None:
        rows = rows.withColumn(w, F.when(wanted, F.col(w)))
    rows = rows.select("*", _repeat_words(F.col(w)).alias(z))
    rows = rows.select("*", _candidates(F.col(z)).alias(c)).drop(z)
    rows = rows.select("*", _confirmed(F.col(c), F.col(w)).alias(d)).drop(c, w)
    rows = rows.select("*", _starts(F.col(d)).alias(p)).drop(d)
    return rows.select(*kept, *cheap, F.when(unknown, _covered(F.col(p))).alias("n_repeat_words"))


def _failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    return _measured(docs, text).withColumn("base_failed", _failed())


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """Rules ordered by rejections per second on a sample of about ``sample_rows`` rows (the whole table if smaller)."""
    total = docs.count()
    if not total:
        return rules
    sample = materialize(measures(docs.select(text).sample(min(1.0, sample_rows / total), seed=7), text), "quality-sample")

    def run(column: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(column).alias("n")).first()["n"]
        return time.perf_counter() - began, rejected

    run(F.lit(True))  # the first job also reads the files' footers
    idle = run(F.lit(True))[0]
    rated = []
    for rule in rules:
        seconds, rejected = run(rule.rejects)
        rated.append((rejected / max(seconds - idle, 1e-3), rule))
    return [rule for _, rule in sorted(rated, key=lambda x: -x[0])]


def verdict(rules: list[Rule], failed: Column | None = None) -> Column:
    """Name of the first rule that rejects the row, in cascade order, or null."""
    out = F.when(F.col("base_failed") if failed is None else failed, F.lit("base"))
    for rule in rules:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def rate_documents(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``measures`` plus rejected_by (null where kept) and kept."""
    ordered = plan_cascade(docs, rules if rules is not None else default_rules(text), text=text)
    rated = measures(docs, text).withColumn("rejected_by", verdict(ordered))
    return rated.withColumn("kept", F.col("rejected_by").isNull())


def keep_documents(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that ``rate_documents`` keeps, with the input's columns. Repeated words, which cost most of all measures, are
    searched only in rows that the rules without them, in cascade order, let pass."""
    ordered = plan_cascade(docs, rules if rules is not None else default_rules(text), text=text)
    first = F.when(F.col("n_words") < BASE_WORDS, F.lit("base"))
    for rule in ordered:
        first = first if rule.repeats else first.when(rule.rejects, F.lit(rule.name))
    rows = _measured(docs, text, first.isNull()).where(F.col("n_repeat_words").isNotNull())
    return rows.where(verdict([r for r in ordered if r.repeats], _failed()).isNull()).select(*map(quoted, docs.columns))
