"""Personal data: patterns propose spans, checks confirm them, context words adjust a score.

Four base kinds (email, ip, card, phone) are found leftmost and non-overlapping per kind; spans that fail their check are
dropped without a retry. The method adds one kind of its own: ``iban``, confirmed by the mod-97 check and kept where its score,
base confidence plus what nearby words add or take, reaches a threshold. Base spans stay whatever their score.

Positions are code points with exclusive ends. They come from cutting a text at a pattern's matches: a match begins after all
pieces and matches before it, so no search by position is needed and the work is linear in the text.

Patterns are the contract's, written with possessive repeats and a look-behind at the start of a run. Both leave the matches
as they are (what follows a repeat is never in its character class) and keep long runs linear.

Nulls: a null text counts as empty and has no spans. Very long texts, also with very many matches, cost near linear time. Repeated rows get equal results; an
empty table gives an empty one. ``find`` keeps all input columns and prefixes its own with ``pii_``; columns of that name are
replaced. ``redact`` adds no column, so all input columns come back as they are but for the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import bind, quoted, running

#: Characters before and after a span that are searched for context words.
CONTEXT_CHARS = 40
IBAN_THRESHOLD = 0.5
#: Characters of the blocks by which positions in a text are found.
BLOCK_CHARS = 256


@dataclass(frozen=True)
class Kind:
    """``gate`` is a cheap necessary condition on the text, ``valid`` the check on a match."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    base_score: float
    likely: str
    unlikely: str
    threshold: float = 0.0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Luhn's checksum over the digits of a match."""
    reversed_digits = F.split(F.reverse(_digits(match)), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(reversed_digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """The IBAN check: country and check digits moved to the end, letters as numbers, remainder 1 modulo 97."""
    bare = F.translate(match, " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    numbers = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: The contract's patterns and the method's own, in the order in which spans are listed.
EMAIL = Kind(
    "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), 0.9, r"\b(?:e-?mail|mail|contact|write|address)\b", r"\b(?:example|noreply|git)\b",
)
IP = Kind(
    "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\b(?:ip|host|server|address|login)\b", r"\b(?:version|release|section)\b",
)
CARD = Kind(
    "card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda m: F.length(_digits(m)).between(16, 19) & luhn(m), 0.8, r"\b(?:card|visa|mastercard|credit|payment|cvv)\b", r"\b(?:order|serial|isbn|tracking)\b",
)
PHONE = Kind(
    "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m)).between(8, 15), 0.7, r"\b(?:tel|phone|call|mobile|fax|dial)\b", r"\b(?:id|order|ref)\b",
)
IBAN = Kind(
    "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), mod97, 0.7, r"\b(?:iban|bank|account|transfer|bic|swift)\b", r"\b(?:serial|part|model)\b", IBAN_THRESHOLD,
)
BASE = [EMAIL, IP, CARD, PHONE]
KINDS = [*BASE, IBAN]


def _spans(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of the confirmed matches of one kind, in order of start."""
    found = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["pieces"], 1, F.size(x["matches"])), x["matches"], lambda before, m: F.length(before) + F.length(m))

        def spans(ends: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                near = F.lower(F.concat_ws(" ", F.right(F.get(x["pieces"], i), F.lit(CONTEXT_CHARS)), F.left(F.get(x["pieces"], i + 1), F.lit(CONTEXT_CHARS))))
                score = F.lit(kind.base_score) + F.when(near.rlike(kind.likely), 0.1).otherwise(0.0) - F.when(near.rlike(kind.unlikely), 0.3).otherwise(0.0)
                end = F.get(ends, i)
                whole = F.struct(F.lit(kind.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.round(score, 2).alias("score"))
                return F.when(kind.valid(m), whole)

            return F.filter(F.transform(x["matches"], span), lambda s: s.isNotNull())

        return bind(running(lengths, lambda a, b: a + b, F.lit(0)), spans)

    out = bind(found, placed)
    if kind.threshold:
        out = F.filter(out, lambda s: s["score"] >= kind.threshold)
    return F.when(kind.gate(text), out).otherwise(none)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns plus pii_<kind> (spans of each kind), one array column per kind of ``KINDS``."""
    kept = [quoted(c) for c in docs.columns if not c.startswith("pii_")]
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*kept, *(_spans(t, kind).alias(f"pii_{kind.name}") for kind in KINDS))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, span lists, their digest and the scores of all spans."""
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    base = F.concat(*(F.col(f"pii_{k.name}") for k in BASE))
    every = F.concat(*(F.col(f"pii_{k.name}") for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _merged(spans: Column) -> Column:
    """Spans (start, end, kind) in order of start, with those that overlap joined under the first one's kind."""

    def joined(s: Column) -> Column:
        def cut(most: Column) -> Column:
            begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(most, i - 1)), i)), lambda i: i.isNotNull())
            last = lambda p, i: F.get(most, F.coalesce(F.get(p, i + 1), F.size(s)) - 1)
            return bind(begins, lambda p: F.transform(p, lambda b, i: F.struct(F.get(s, b)["start"].alias("start"), last(p, i).alias("end"), F.get(s, b)["kind"].alias("kind"))))

        return bind(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0)), cut)

    return bind(spans, joined)


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the disjoint, ordered ``spans`` as ``[KIND]``. Positions are found by blocks, not from the start of the text."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))

    def built(x: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            first = F.floor(low / BLOCK_CHARS).cast("int")
            near = F.array_join(F.slice(x["b"], first + 1, F.floor(high / BLOCK_CHARS).cast("int") - first + 1), "")
            return F.substring(near, low - first * BLOCK_CHARS + 1, high - low)

        end = lambda i: F.coalesce(F.get(x["s"], i)["end"], F.lit(0))
        parts = F.transform(x["s"], lambda s, i: F.concat(between(end(i - 1), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(end(F.size(x["s"]) - 1), F.length(text)))

    return bind(F.struct(blocks.alias("b"), spans.alias("s")), built)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns with every found span of ``text`` replaced by ``[KIND]``; spans that overlap become one replacement."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*(_spans(t, kind) for kind in KINDS))
    ordered = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    new = bind(every, lambda spans: F.when(F.size(spans) > 0, _replaced(t, _merged(ordered(spans)))))
    return docs.withColumn(text, F.coalesce(new, F.col(text)))
