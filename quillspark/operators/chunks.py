"""Text structure as tables: chunks between anchors, their density, fences, units and candidate segments, places of quotes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import text as t
from quillspark.operators.asof import as_of
from quillspark.operators.skew import lookup
from quillspark.plans.scratch import Scratch

OVERLAP = 0.1
LOT = 4096  # quotes that are looked for in one scan of a text
BATCH_BYTES = 4 << 20
BATCH_CHUNKS = 256  # chunks whose units are in Python at a time
PLACES = "path string, quote string, verdict string, n_places int, start int, end int, n bigint"
#: What ``functions.text.norm`` takes out, and a character that it leaves.
UNMARKED = regex.compile(r"[ \t\n\x0b\f\r\p{P}\p{S}]+")
MARKED_CHAR = regex.compile(r"[^ \t\n\x0b\f\r\p{P}\p{S}]")
# Fixed values of segmentation.
SEGMENT_LIMIT, SEGMENT_LEAST, GLUE_LEAST = 1500, 300, 400
HEADING = r"^#{1,6}\s+(.*)$"
TIMESTAMP = r"^\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s*\S"


def lines(docs: DataFrame) -> DataFrame:
    """(path, text, n, line, start): the lines of each text and where they begin."""
    rows = docs.select("path", "text", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def split_chunks(docs: DataFrame) -> DataFrame:
    """(path, idx, heading, char_start, char_end, segment): a chunk runs from an anchor to the next one.

    Anchors are headings and lines that begin with a time. What stands before the first anchor is in no chunk; a text
    without anchors is one chunk. Line starts are found within each text's own array, so texts stay where they are.
    """
    starts = F.aggregate(
        F.split("text", "\n"),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,heading:string>>)").alias("out")),
        lambda acc, line: F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"),
            F.when(line.rlike(f"{HEADING}|{TIMESTAMP}"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), _heading(line).alias("heading"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("heading")))
    anchored = docs.withColumn("_a", starts).withColumn("_a", F.when(F.size("_a") > 0, F.col("_a")).otherwise(whole))
    rows = anchored.select("path", "text", "_a", F.posexplode("_a").alias("idx", "a"))
    end = F.coalesce(F.try_element_at("_a", F.col("idx") + 2)["start"], F.length("text"))
    rows = rows.select("path", "text", "idx", F.col("a.heading").alias("heading"), F.col("a.start").alias("char_start"), end.alias("char_end"))
    return rows.withColumn("segment", F.col("text").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("text")


def _heading(line: Column) -> Column:
    head, time = F.regexp_extract(line, HEADING, 1), F.regexp_extract(line, TIMESTAMP, 1)
    return F.trim(F.when(line.rlike(HEADING), head).otherwise(time))


def map_documents(docs: DataFrame) -> DataFrame:
    """The chunks of (path, text) with their features, density and verdict."""
    length = F.col("char_end") - F.col("char_start")
    rows = split_chunks(docs).withColumn("char_len", length).withColumn("features", t.chunk_features(F.col("segment"), F.col("heading")))
    rows = rows.withColumn("density", t.density(F.col("features"))).withColumn("high_value", t.high_value(F.col("char_len"), F.col("density"), F.col("features")))
    return rows.select(
        t.doc_key(F.col("path")).alias("doc_id"), "path", F.concat(t.doc_key(F.col("path")), F.lit("-"), F.col("idx").cast("string")).alias("chunk_id"), "idx", "heading", "char_start", "char_end", "char_len",
        F.greatest(F.lit(0), F.col("char_start") - F.floor(F.col("char_len") * OVERLAP)).cast("int").alias("overlap_start"),
        "features", "density", "high_value", t.candidate_topics(F.col("heading")).alias("candidate_topics"), t.skip_reason(F.col("char_len"), F.col("high_value")).alias("skip_reason"), "segment",
    )


def coverage(chunks: DataFrame) -> DataFrame:
    """(path, chunks_total, high_value, low_value) by document."""
    high = F.sum(F.col("high_value").cast("bigint"))
    return chunks.groupBy("path").agg(F.count("*").alias("chunks_total"), high.alias("high_value"), (F.count("*") - high).alias("low_value"))


# Fences, units, segments -------------------------------------------------------------------------------------------


def fences(text: Column) -> Column:
    """Array of (start, end) of fenced blocks; a closing fence has at least the opening one's length, what is never closed is none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("open"), F.lit(0).alias("ticks"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        opening = F.length(F.regexp_extract(line, r"^[ \t]{0,3}(`{3,})", 1))
        closing = F.length(F.regexp_extract(line, r"^[ \t]{0,3}(`{3,})[ \t]*$", 1))
        opens = (acc["open"] < 0) & (opening > 0)
        closes = (acc["open"] >= 0) & (closing >= acc["ticks"]) & (closing > 0)
        end = acc["at"] + F.length(line)
        return F.struct(
            (end + 1).alias("at"),
            F.when(opens, acc["at"]).when(closes, F.lit(-1)).otherwise(acc["open"]).alias("open"),
            F.when(opens, opening).otherwise(acc["ticks"]).alias("ticks"),
            F.when(closes, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["out"])


def units(chunks: DataFrame) -> DataFrame:
    """(chunk_id, unit, start, len, pseudo, kind, text) of (chunk_id, segment): stretches between blank lines outside fences and fence edges."""
    spans = chunks.select("chunk_id", "segment", fences(F.col("segment")).alias("spans"))
    n = F.length("segment")
    # Ends of blank lines: what stands before a gap, and the gap.
    pieces, gaps = F.split("segment", r"\n[ \t]*\n", -1), F.regexp_extract_all("segment", F.lit(r"\n[ \t]*\n"), F.lit(0))
    ends = F.aggregate(
        F.zip_with(F.slice(pieces, 1, F.size(gaps)), gaps, lambda p, g: F.length(p) + F.length(g)),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")),
        lambda acc: acc["out"],
    )
    outside = F.filter(ends, lambda e: ~F.exists("spans", lambda s: (s["start"] <= e) & (e < s["end"])))
    edges = F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"])))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), outside, F.filter(edges, lambda e: (e > 0) & (e < n)))))
    rows = spans.withColumn("cuts", cuts).select("chunk_id", "segment", "spans", "cuts", F.posexplode("cuts").alias("i", "start"))
    rows = rows.withColumn("end", F.try_element_at("cuts", F.col("i") + 2)).where(F.col("end") > F.col("start"))
    rows = rows.withColumn("text", F.col("segment").substr(F.col("start") + 1, F.col("end") - F.col("start"))).where(F.col("text").rlike(r"\S"))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    fenced = F.exists("spans", lambda s: (s["start"] <= middle) & (middle < s["end"])) | F.col("text").rlike(r"^\s*```")
    table = F.substring_index("text", "\n", 1).rlike(r"(?i)^\s*(?:\||<table|</table|<tbody|<tr|<colgroup)") & t.media_table(F.col("text"))
    kind = F.when(fenced, "fence").when(table, "media_table").otherwise("normal")
    return rows.select("chunk_id", F.col("i").alias("unit"), "start", (F.col("end") - F.col("start")).alias("len"), t.pseudo_heading(F.col("text")).alias("pseudo"), kind.alias("kind"), "text")


SEGMENTS = "chunk_id string, start int, len int, pseudo int, dense boolean, frag boolean, oversized_fence boolean, oversized_frag boolean, dropped boolean"


class _Open:
    """The segment that is being filled."""

    def __init__(self, start: int, end: int, pseudo: int, tail: str, frag: bool = False):
        self.start, self.end, self.pseudo, self.tail, self.frag = start, end, pseudo, tail, frag

    @property
    def size(self) -> int:
        return self.end - self.start

    def leads_on(self) -> bool:
        """Whether the last line is a heading, or ends with a colon or dash: an introduction to what follows."""
        last = self.tail.rstrip().rsplit("\n", 1)[-1].strip()
        return last.lstrip("#").startswith(" ") and last.startswith("#") or last[-1:] in tuple(":：—-")


class _Unit(NamedTuple):
    unit: int
    start: int
    len: int
    pseudo: bool
    kind: str
    text: str


def _segments_of(chunk: list[_Unit], limit: int) -> Iterator[dict]:
    open_: _Open | None = None

    def row(start: int, size: int, pseudo: int, **flags: bool) -> dict:
        return {"start": start, "len": size, "pseudo": pseudo, "dense": pseudo >= 2, **dict.fromkeys(("frag", "oversized_fence", "oversized_frag", "dropped"), False), **flags}

    def closed(s: _Open | None) -> Iterator[dict]:
        if s:
            yield row(s.start, s.size, s.pseudo, frag=s.frag, oversized_frag=s.frag and s.size > limit)

    for u in chunk:
        grown = (open_.size if open_ else 0) + u.len
        if u.kind == "media_table":
            yield from closed(open_)
            open_ = None
            yield row(u.start, u.len, int(u.pseudo), dropped=True)
        elif u.kind == "fence" and not (open_ and grown <= limit):
            yield from closed(open_)
            open_ = None
            yield row(u.start, u.len, int(u.pseudo), oversized_fence=u.len > limit)
        elif u.kind == "normal" and u.len > limit:
            # A long stretch joins a short introduction, once; else it stands alone.
            if open_ and not open_.frag and (open_.size <= GLUE_LEAST or open_.leads_on()) and grown <= 3 * limit:
                open_ = _Open(open_.start, u.start + u.len, open_.pseudo + u.pseudo, u.text, frag=True)
            else:
                yield from closed(open_)
                open_ = _Open(u.start, u.start + u.len, int(u.pseudo), u.text, frag=True)
        elif open_ and (u.kind == "fence" or not (grown > limit or u.pseudo and open_.size >= SEGMENT_LEAST)):
            open_.end += u.len
            open_.pseudo += int(u.pseudo)
            open_.tail = u.text
        else:
            yield from closed(open_)
            open_ = _Open(u.start, u.start + u.len, int(u.pseudo), u.text)
    yield from closed(open_)


def segments(chunks: DataFrame, limit: int = SEGMENT_LIMIT) -> DataFrame:
    """Candidate segments of high-value chunks: see ``SEGMENTS``."""
    return segments_of(units(chunks), limit)


def segments_of(found: DataFrame, limit: int = SEGMENT_LIMIT) -> DataFrame:
    """The same from the chunks' ``units``. What is open depends on what came before, so a chunk's units go together, as one row in their order."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = {name: kinds[kind] for name, kind in (c.split() for c in SEGMENTS.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH_CHUNKS):
                keys, lists = (b.column(c).slice(i, BATCH_CHUNKS).to_pylist() for c in (0, 1))
                rows = [{"chunk_id": key, **r} for key, chunk in zip(keys, lists, strict=True) for r in _segments_of([_Unit(**u) for u in chunk], limit)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(columns.items())))

    gathered = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*_Unit._fields))).alias("units"))
    return gathered.mapInArrow(run, SEGMENTS)


# Places ------------------------------------------------------------------------------------------------------------


def locate(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, quote, verdict, n_places, start, end): the span of quotes (path, quote) in texts (path, text).

    ``unique`` and ``ambiguous`` count exact places, overlapping ones too; ``normalized`` compares without white space and marks and maps the
    place back; else ``missing``, as are null and empty quotes and all quotes of a null text. A text's quotes are gathered, ``LOT`` at most, and
    found in one scan by an automaton of all of them; quotes of texts that are not there are left out, repeated ones stay.
    """
    spark, scratch = quotes.sparkSession, Scratch(quotes.sparkSession, "locate")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = scratch.store(quotes.where("path is not null").groupBy("path", "quote").agg(F.count("*").alias("n")), "quotes")
    lots = rows.groupBy("path").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    dealt = lookup(rows, lots, "path", rows.count()).withColumn("lot", F.pmod(F.xxhash64("quote"), "lots"))
    asked = dealt.groupBy("path", "lot").agg(F.collect_list(F.struct("quote", "n")).alias("quotes"))
    found = asked.join(docs.select("path", "text"), "path").select("path", "text", "quotes").mapInArrow(_located, PLACES)
    return found.select("path", "quote", "verdict", "n_places", "start", "end", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, text, asked in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            places = _places_of({q["quote"] for q in asked}, text or "")
            rest = {q["quote"]: UNMARKED.sub("", q["quote"]) for q in asked if q["quote"] and q["quote"] not in places} if text else {}
            kept = [m.start() for m in MARKED_CHAR.finditer(text)] if any(rest.values()) else []
            near = _places_of(set(rest.values()), "".join(text[i] for i in kept)) if kept else {}
            for q in asked:
                quote, n = q["quote"], q["n"]
                if quote in places:
                    count, at = places[quote]
                    out.append((path, quote, "unique" if count == 1 else "ambiguous", count, at, at + len(quote), n))
                elif rest.get(quote) in near:
                    at = near[rest[quote]][1]
                    out.append((path, quote, "normalized", 0, kept[at], kept[at + len(rest[quote]) - 1] + 1, n))
                else:
                    out.append((path, quote, "missing", 0, None, None, n))
        names, types = zip(*(c.rsplit(" ", 1) for c in PLACES.split(", ")), strict=True)
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[t]) for i, t in enumerate(types)], names=list(names))


def _places_of(quotes: set[str | None], text: str) -> dict[str, tuple[int, int]]:
    """How often each quote that is not empty stands in the text, and where first."""
    automaton = ahocorasick.Automaton()
    for quote in quotes:
        if quote:
            automaton.add_word(quote, quote)
    found: dict[str, tuple[int, int]] = {}
    if len(automaton) and text:
        automaton.make_automaton()
        for end, quote in automaton.iter(text):
            count, first = found.get(quote, (0, end + 1 - len(quote)))
            found[quote] = count + 1, first
    return found


def chunk_at(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """Places (path, start, ...) with the chunk that holds each; null where none does. A document's chunks do not overlap."""
    columns = ("chunk_id", "heading", "char_start", "char_end", "high_value")
    found = as_of(places, chunks.select("path", *[c for c in columns if c in chunks.columns]), "path", "start", "char_start")
    inside = F.col("start") < F.col("held.char_end")
    return found.select(*places.columns, *[F.when(inside, F.col(f"held.{c}")).alias(c) for c in columns if c in chunks.columns])


def best_evidence(lines_: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each line (line_id, line) the evidence (evidence_id, quote) that shares most of its terms, ties by id."""
    words = lines_.select("line_id", t.query_grams(F.col("line")).alias("w"))
    pairs = words.select("line_id", F.size("w").alias("n"), F.explode("w").alias("gram")).join(evidence.select("evidence_id", F.explode(t.query_grams(F.col("quote"))).alias("gram")), "gram")
    share = pairs.groupBy("line_id", "evidence_id").agg((F.count("*") / F.first("n")).alias("share"))
    order = Window.partitionBy("line_id").orderBy(F.desc("share"), "evidence_id")
    return share.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
