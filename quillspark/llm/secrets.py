"""Secret scans as column expressions: fixed patterns, and sliding-window entropy over candidate strings.

Base spans come from three patterns. The method adds spans: for each character class, runs of its characters that are
at least one window long are candidates. A fold moves a window along the candidate and keeps the count of each
character (five bits of a long each) and the sum of c * log2(c) over the counts c; one character enters and one leaves, so each step changes two
counts. Where the window's entropy, log2(w) - sum / w, reaches the class's threshold, the window is part of a span.
Candidates on the allow list (placeholders, alphabets, counting sequences, uuids) and spans within a base span are
suppressed. Positions are code points, ends exclusive.

Everything is built-in functions on the one row: no shuffle, no Python on the executors.

Edge cases: a null or empty text has no spans; rows with null or repeated ids are scanned like others; an empty table
gives an empty result; further columns, also ones named like the result's, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
RUN = 64
PACKED, BITS = 12, 5  # counts in a long, and bits of each: a window is shorter than 2**BITS
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


@dataclass(frozen=True)
class CharClass:
    """Characters whose runs are candidates, the window's width, and the entropy in bits from which it counts."""

    kind: str
    pattern: str  # of one character
    alphabet: str
    window: int
    bits: float
    needs: str  # a candidate without a match of this is no secret


CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]", "0123456789abcdefABCDEF", 20, 3.0, "[0-9][A-Fa-f]|[A-Fa-f][0-9]"),
    CharClass("entropy_upper", "[A-Z0-9]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.5, "[0-9][A-Z]|[A-Z][0-9]"),
    CharClass("entropy_base64", "[A-Za-z0-9+/_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0, "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"),
)
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0123456789|1234567890|abcdefghij|"
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of some numbers what ``op`` (a sum or a maximum) makes of those before it, from zero on.

    Runs of ``RUN`` are folded by themselves and then their totals, so the work does not grow with the square of the length.
    """

    def fold(array: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(array, start, lambda acc, x: F.struct(op(acc["at"], value(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def before(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), lambda i: F.slice(own, i * RUN + 1, F.lit(RUN)))
        folded = F.transform(runs, lambda r: fold(r, lambda x: x))
        spread = F.transform(F.array(folded), lambda local: F.zip_with(fold(local, lambda r: r["at"])["out"], local, lambda o, r: F.transform(r["out"], lambda x: op(o, x))))
        return F.when(F.size(own) > 0, F.flatten(F.element_at(spread, 1))).otherwise(F.expr("cast(array() as array<int>)"))

    # One-element arrays name what is used several times: else it would be worked out again for each run.
    return F.element_at(F.transform(F.array(values), before), 1)


def _located(text: Column, pattern: str, extra: int | None = None) -> Column:
    """Array of (start, text, group) of the pattern's matches: what stands between matches gives their places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(extra)) if extra else found
    matches = F.zip_with(found, group, lambda m, g: F.struct(m.alias("text"), g.alias("group")))
    gaps = F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g))
    before = _before(F.zip_with(gaps, found, lambda g, m: g + F.length(m)), lambda x, y: x + y)
    starts = F.zip_with(before, gaps, lambda at, g: at + g)
    return F.zip_with(starts, matches, lambda at, m: F.struct(at.alias("start"), m["text"].alias("text"), m["group"].alias("group")))


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _span(kind: str, order: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def base_spans(text: Column) -> Column:
    """Array of spans (start, ord, kind, end) of the three fixed patterns."""

    def of(order: int, pattern: str, gate: Column, group: int | None = None) -> Column:
        found = _located(text, pattern, group)
        if group:
            found = F.filter(found, lambda m: F.length(m["group"]) >= 6)
        spans = F.transform(found, lambda m: _span(BASE_KINDS[order], order, m["start"], m["start"] + F.length(m["text"])))
        return F.when(gate, spans).otherwise(_no_spans())

    named = (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN)
    return F.concat(of(0, ASSIGN, named, 2), of(1, ACCESS, text.contains("AKIA") & text.rlike(ACCESS)), of(2, HEX, text.rlike(HEX)))


def _plog(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def dense_window(s: Column, c: CharClass) -> Column:
    """(lo, hi): first and last end, from 1, of a window of ``s`` whose entropy reaches the threshold; null if none."""
    chars = F.split(s, "")
    zero = F.array_repeat(F.lit(0).cast("bigint"), -(-len(c.alphabet) // PACKED))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    alphabet = F.lit(c.alphabet)

    def slot(i: Column) -> Column:
        """Place of the i-th character in the alphabet, from 1; 0 before the string."""
        return F.when(i >= 1, F.position(F.element_at(chars, F.greatest(i, F.lit(1))), alphabet)).otherwise(F.lit(0))

    def move(acc: Column, i: Column) -> Column:
        moved = F.struct(slot(i).alias("new"), slot(i - c.window).alias("old"), acc.alias("acc"), i.alias("i"))
        # One-element arrays name values that are used several times.
        return F.element_at(F.transform(F.array(moved), lambda m: _moved(m, c)), 1)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), start, move, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _shift(slot: Column) -> Column:
    return F.pmod(slot - 1, F.lit(PACKED)) * BITS


def _count(counts: Column, slot: Column) -> Column:
    """The count of a character of the alphabet."""
    word = F.element_at(counts, F.floor((slot - 1) / PACKED).cast("int") + 1)
    return F.call_function("shiftrightunsigned", word, _shift(slot)).bitwiseAND((1 << BITS) - 1)


def _one(slot: Column, k: Column) -> Column:
    """What one character adds to the k-th long."""
    return F.when(F.floor((slot - 1) / PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), _shift(slot))).otherwise(F.lit(0).cast("bigint"))


def _moved(m: Column, c: CharClass) -> Column:
    counts, new, old, i = m["acc"]["counts"], m["new"], m["old"], m["i"]
    same = new == old
    gain = _count(counts, new)
    loss = F.when(old > 0, _count(counts, F.greatest(old, F.lit(1))))
    total = m["acc"]["total"] + F.when(same, F.lit(0.0)).otherwise(_plog(gain + 1) - _plog(gain) + F.when(old > 0, _plog(loss - 1) - _plog(loss)).otherwise(F.lit(0.0)))
    moved = F.transform(counts, lambda n, k: n + _one(new, k) - F.when(old > 0, _one(old, k)).otherwise(F.lit(0).cast("bigint")))
    dense = (i >= c.window) & (F.lit(math.log2(c.window)) - total / c.window >= c.bits - 1e-9)
    lo = F.when(dense, F.coalesce(m["acc"]["lo"], i)).otherwise(m["acc"]["lo"])
    return F.struct(F.when(same, counts).otherwise(moved).alias("counts"), total.alias("total"), lo.alias("lo"), F.when(dense, i).otherwise(m["acc"]["hi"]).alias("hi"))


def _class_spans(text: Column, order: int, c: CharClass) -> Column:
    pattern = f"{c.pattern}{{{c.window},}}"
    found = F.filter(_located(text, pattern), lambda m: m["text"].rlike(c.needs) & ~m["text"].rlike(ALLOWED))
    dense = F.transform(found, lambda m: F.struct(m["start"].alias("start"), dense_window(m["text"], c).alias("w")))
    dense = F.filter(dense, lambda d: d["w"]["lo"].isNotNull())
    spans = F.transform(dense, lambda d: _span(c.kind, order, d["start"] + d["w"]["lo"] - c.window, d["start"] + d["w"]["hi"]))
    return F.when(text.rlike(pattern), spans).otherwise(_no_spans())


def entropy_spans(text: Column) -> Column:
    """Array of spans (start, ord, kind, end) by sliding-window entropy, allow list applied."""
    return F.concat(*[_class_spans(text, len(BASE_KINDS) + n, c) for n, c in enumerate(CLASSES)])


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``_spans``: base spans, and the added ones that no base span holds, by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn("_base", base_spans(text)).withColumn("_added", entropy_spans(text))
    def apart(spans: Column) -> Column:
        # In this order all base spans that begin no later stand before an added one.
        reached = _before(F.transform(spans, lambda s: F.when(s["ord"] < len(BASE_KINDS), s["end"]).otherwise(F.lit(0))), F.greatest)
        kept = F.zip_with(spans, reached, lambda s, at: F.when((s["ord"] < len(BASE_KINDS)) | (at < s["end"]), s))
        return F.filter(kept, lambda s: s.isNotNull())

    merged = F.array_sort(F.concat("_base", "_added"))
    return found.withColumn("_spans", F.element_at(F.transform(F.array(merged), apart), 1)).drop("_base", "_added")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _of_kind(order: int) -> Column:
    return F.filter("_spans", lambda s: s["ord"] == order)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    found = with_spans(docs.select("doc_id", "text")).drop("text")
    counts = [F.size(_of_kind(k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    base = F.filter("_spans", lambda s: s["ord"] < len(BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by ``mark``, and ``n_chars``, if there, counted anew.

    Spans that overlap are replaced as one. Texts without spans stay as they are.
    """
    chars = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    reached = _before(F.transform("_spans", lambda s: s["end"]), F.greatest)

    def pieces(c: Column) -> Column:
        part = lambda start, end: F.array_join(F.slice(c, start + 1, F.greatest(end - start, F.lit(0))), "")
        kept = F.zip_with("_spans", reached, lambda s, at: F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform("_spans", lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), part(last, F.size(c)))

    # A one-element array names the characters, which are used for every piece.
    cleaned = F.element_at(F.transform(F.array(chars), pieces), 1)
    # The row's own columns stay in a struct, so that none of them can meet a name used here.
    found = with_spans(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"]))
    hit, row = F.size("_spans") > 0, F.col("_row").withField("text", F.col("_clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_clean").cast(docs.schema["n_chars"].dataType))
    found = found.withColumn("_clean", F.when(hit, cleaned)).select(F.when(hit, row).otherwise(F.col("_row")).alias("_row"))
    return found.select("_row.*")
