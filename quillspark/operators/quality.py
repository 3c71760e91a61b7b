"""Quality rules as rows: every check gives (subject, code, status) or counts, so that they can be grouped and gated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from quillspark.functions import text as t
from quillspark.operators.chunks import chunk_at

# Bounds and vocabularies of the rules.
HOOKS_LEAST, HOOKS_MOST = 3, 5
HOOK_SHORTEST, HOOK_LONGEST = 6, 40
UNIT_TYPES = ("claim", "concept", "qa", "open_question", "relation", "procedure", "conflict", "asset")
CONFIDENCE = ("high", "medium", "low")
UNIT_FIELDS = {
    "claim": ("text",),
    "concept": ("name", "definition"),
    "qa": ("question", "answer"),
    "open_question": ("question",),
    "relation": ("subject", "predicate", "object"),
    "procedure": ("goal", "steps"),
    "conflict": ("sources", "positions"),
    "asset": ("name",),
}
LARGE_NOTE = 200 * 1024
INBOX_SHARE, INBOX_LEAST = 0.2, 10
LARGE_FENCE = 3000


def rules(rows: DataFrame, subject: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(subject, code, status) for each row and check (code, status, condition) that holds."""
    hits = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))) for code, status, condition in checks]))
    return rows.select(F.col(subject).alias("subject"), F.explode(hits).alias("h")).select("subject", "h.code", "h.status")


def verdicts(found: DataFrame) -> DataFrame:
    """(status, n)."""
    return found.groupBy("status").agg(F.count("*").alias("n"))


def write_rules(found: DataFrame, folder: str, statuses: tuple[str, ...] = ("pass", "info", "warning", "warn", "error", "fail", "na")) -> dict[str, int]:
    """Write (subject, code, status) rows and return how many there are, in all (``rows``) and of each status, counted while they are written."""
    totals = Observation()
    each = [F.count(F.when(F.col("status") == s, F.lit(1))).alias(s) for s in statuses]
    found.observe(totals, F.count(F.lit(1)).alias("rows"), *each).write.mode("overwrite").parquet(folder)
    return {name: int(n or 0) for name, n in totals.get.items()}


# Hooks -------------------------------------------------------------------------------------------------------------


def hook_rules(notes: DataFrame) -> DataFrame:
    """(subject, code, n): what is wrong with the questions kept with notes (path, q_hooks); an empty list is a signal only."""
    size = F.size(F.coalesce("q_hooks", F.expr("cast(array() as array<string>)")))
    whole = rules(notes, "path", [("empty", "signal", size == 0), ("too_few", "invalid", (size > 0) & (size < HOOKS_LEAST)), ("too_many", "invalid", size > HOOKS_MOST)])
    items = notes.select("path", F.posexplode("q_hooks").alias("i", "hook"))
    shaped = F.col("hook").rlike(r"^[\[{]") | (F.col("hook").contains("text") & F.col("hook").contains(":"))
    blank, comma = F.trim("hook") == "", F.col("hook").rlike("[,，]")
    clean = ~shaped & ~blank & ~comma
    items = items.withColumn("clean", clean)
    length = F.length(F.trim("hook"))
    each = rules(
        items,
        "path",
        [
            ("not_string", "invalid", shaped),
            ("empty_item", "invalid", ~shaped & blank),
            ("comma_in_item", "invalid", ~shaped & ~blank & comma),
            ("too_short", "invalid", F.col("clean") & (length < HOOK_SHORTEST)),
            ("too_long", "invalid", F.col("clean") & (length > HOOK_LONGEST)),
            ("newline", "invalid", F.col("clean") & F.col("hook").rlike(r"[\r\n]|\\n|\\r")),
        ],
    )
    key = t.norm(F.lower("hook"))
    again = F.row_number().over(Window.partitionBy("path", "key").orderBy("i"))
    doubled = items.where("clean").withColumn("key", key).where("key <> ''").withColumn("r", again).where("r > 1").select(F.col("path").alias("subject"), F.lit("dup").alias("code"), F.lit("invalid").alias("status"))
    return whole.union(each).union(doubled).groupBy("subject", "code", "status").agg(F.count("*").alias("n"))


def backfill(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, verdict, hooks): what to do for notes without valid hooks, from candidates (doc_id, hooks) by path or file name."""
    bad = hook_rules(notes).where("status = 'invalid'").select(F.col("subject").alias("path")).distinct().withColumn("bad", F.lit(True))
    rows = notes.select("path", "q_hooks", F.substring_index("path", "/", -1).alias("name")).join(bad, "path", "left")
    by_path = candidates.select(F.col("doc_id").alias("path"), F.col("hooks").alias("own"))
    by_name = candidates.groupBy(F.substring_index("doc_id", "/", -1).alias("name")).agg(F.min_by("hooks", "doc_id").alias("named"))
    rows = rows.join(by_path, "path", "left").join(by_name, "name", "left").withColumn("hooks", F.coalesce("own", "named"))
    missing = F.col("q_hooks").isNull() | (F.size("q_hooks") <= 0)
    state = F.when(missing & F.col("hooks").isNull(), "no_candidate").when(missing, "write").when(F.col("bad"), F.when(F.col("hooks").isNotNull(), "replace").otherwise("invalid")).otherwise("ok")
    return rows.select("path", state.alias("verdict"), F.when(state.isin("write", "replace"), F.col("hooks")).alias("hooks"))


def hook_coverage(notes: DataFrame) -> DataFrame:
    """(hooks, notes): how many notes have how many hooks."""
    return notes.groupBy(F.greatest(F.size(F.coalesce("q_hooks", F.expr("cast(array() as array<string>)"))), F.lit(0)).alias("hooks")).agg(F.count("*").alias("notes"))


# Units -------------------------------------------------------------------------------------------------------------


def _absent(field: str, columns: list[str]) -> Column:
    if field not in columns:
        return F.lit(True)
    return F.coalesce(F.size(field) <= 0, F.lit(True)) if field in ("steps", "sources", "positions") else F.coalesce(F.trim(F.col(field).cast("string")) == "", F.lit(True))


def unit_rules(units: DataFrame) -> DataFrame:
    """(subject, code, status) of knowledge units: fields of their type, vocabularies, evidence of what is held for certain."""
    absent = {kind: F.lit(False) for kind in UNIT_TYPES}
    for kind, fields in UNIT_FIELDS.items():
        for f in fields:
            absent[kind] = absent[kind] | _absent(f, units.columns)
    field_gap = F.lit(False)
    for kind, gap in absent.items():
        field_gap = field_gap | ((F.col("type") == kind) & gap)
    known, sure = F.coalesce(F.col("type").isin(*UNIT_TYPES), F.lit(False)), F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False))
    filled = F.exists(F.coalesce("evidence", F.expr("cast(array() as array<struct<file:string,locator:string,quote:string>>)")), lambda e: (F.length(e["file"]) > 0) & (F.length(e["locator"]) > 0) & (F.length(e["quote"]) > 0))
    fine = known & sure & ~field_gap
    few = (F.col("type") == "conflict") & ((F.size("sources") < 2) | (F.size("positions") < 2)) if {"sources", "positions"} <= set(units.columns) else F.lit(False)
    inferred = F.length(F.trim(F.coalesce("inference", F.lit("")))) > 0 if "inference" in units.columns else F.lit(False)
    high = fine & (F.col("confidence") == "high")
    return rules(
        units,
        "id",
        [
            ("bad_type", "error", ~known),
            ("bad_confidence", "error", known & ~sure),
            ("missing_field", "error", known & sure & field_gap),
            ("conflict_needs_two", "error", fine & few),
            ("high_without_evidence", "error", high & ~filled),
            ("low_confidence", "info", fine & (F.col("confidence") == "low")),
            ("high_with_inference", "warning", high & inferred),
        ],
    )


def extraction(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(subject, code, status) of units' evidence against source texts (path, text).

    A quote must stand in the place its locator names, white space aside; numbers and commands of a step must stand
    there to the letter; what has no locator or no readable source is told as unchecked. The same place twice, or a
    quote of a few characters, is no evidence of its own.
    """
    rows = units.select("id", "text", F.posexplode("evidence").alias("i", "e")).select("id", "text", "i", "e.file", "e.quote", F.try_element_at(t.locators(F.col("e.locator")), F.lit(1)).alias("at"))
    placed = rows.join(sources.select(F.col("path").alias("file"), F.col("text").alias("source")), "file", "left")
    span = F.col("source").substr(F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    checked = F.col("at").isNotNull() & F.col("source").isNotNull()
    again = F.row_number().over(Window.partitionBy("id", "file", "at").orderBy("i"))
    placed = placed.withColumn("span", span).withColumn("again", again)
    numbers = F.filter(t.number_tokens(F.coalesce("text", F.lit(""))), lambda x: ~F.col("span").contains(x))
    commands = F.filter(t.command_spans(F.coalesce("text", F.lit(""))), lambda x: ~F.col("span").contains(x))
    found = rules(
        placed,
        "id",
        [
            ("unchecked", "info", ~checked),
            ("quote_not_in_place", "error", checked & ~t.squash(F.col("span")).contains(t.squash(F.col("quote")))),
            ("missing_number", "error", checked & (F.size(numbers) > 0)),
            ("missing_code", "warning", checked & (F.size(commands) > 0)),
            ("evidence_thin", "warning", F.length(t.squash(F.col("quote"))) < 4),
            ("evidence_dup", "warning", F.col("at").isNotNull() & (F.col("again") > 1)),
        ],
    )
    if "steps" not in units.columns:
        return found
    # A procedure whose steps come from several places but that keeps one evidence has lost the others.
    places = lambda c: F.size(F.array_distinct(F.filter(F.transform(c, lambda x: x["locator"]), lambda x: x.isNotNull() & (x != ""))))
    trimmed = (F.col("type") == "procedure") & (places("steps") >= 2) & (places("evidence") <= 1)
    return found.union(rules(units, "id", [("evidence_trimmed", "error", trimmed)]))


def ordered_steps(units: DataFrame) -> DataFrame:
    """(subject, code, status): procedures whose steps are not numbered from one without gaps."""
    orders = F.array_sort(F.transform("steps", lambda s: s["order"]))
    fine = orders == F.sequence(F.lit(1), F.size("steps"))
    return rules(units.where("type = 'procedure' and size(steps) > 0"), "id", [("step_order", "error", ~fine)])


def uncovered(chunks: DataFrame, units: DataFrame, audited: DataFrame) -> DataFrame:
    """High-value chunks that neither a unit nor the coverage table names."""
    touched = units.select("chunk_id").union(audited.select("chunk_id")).distinct()
    return chunks.where("high_value").join(touched, "chunk_id", "left_anti")


def inbox_gate(chunks: DataFrame, audited: DataFrame) -> DataFrame:
    """(path, high, inbox, verdict): too much left in the inbox; documents of few chunks are judged by hand."""
    high = chunks.where("high_value").select("path", "chunk_id").join(audited.where("status = 'inbox'").select("chunk_id", F.lit(1).alias("waits")), "chunk_id", "left")
    counted = high.groupBy("path").agg(F.count("*").alias("high"), F.count("waits").alias("inbox"))
    return counted.withColumn("verdict", F.when(F.col("high") < INBOX_LEAST, "manual").when(F.col("inbox") / F.col("high") > INBOX_SHARE, "fail").otherwise("pass"))


def spot_check(rows: DataFrame, key: str, group: str, per_group: int = 10) -> DataFrame:
    """So many rows of each group, drawn by a hash of their key, so that two runs draw the same."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_group).drop("_r")


def triage_fences(segments: DataFrame) -> DataFrame:
    """Oversized fenced segments: kept whole up to a bound, else to be split by hand."""
    return segments.where("oversized_fence").withColumn("triage", F.when(F.col("len") <= LARGE_FENCE, "whole").otherwise("by_hand"))


# Verbatim numbers --------------------------------------------------------------------------------------------------


def verbatim(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, extra, missing, degraded, cross_block): numbers and commands of a note that its cited blocks lack, and numbers of the main block that it lacks.

    notes (path, body), blocks (path, ord, segment), the main block first. Without blocks the comparison is degraded;
    with several, what is missing is told of the main one only (``cross_block``). Longer numbers stand before shorter ones, and commands
    last. A base that has units is checked by ``extraction`` instead: then pass no notes.
    """
    numbers, commands = t.number_tokens(t.without_noise(t.inference_scope(F.col("body")))), t.command_spans(F.col("body"))
    own = notes.select("path", F.array_distinct(numbers).alias("numbers_said"), F.array_union(numbers, commands).alias("said"))
    sourced = blocks.select("path", "ord", F.array_union(t.number_tokens(t.without_noise(F.col("segment"))), t.command_spans(F.col("segment"))).alias("has"), t.number_tokens(t.without_noise(F.col("segment"))).alias("numbers"))
    held = sourced.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"), F.array_distinct(F.min_by("numbers", "ord")).alias("main"), F.count("*").alias("n"))
    rows = own.join(held, "path", "left")
    none = F.expr("cast(array() as array<string>)")
    noise = r"^(?:\d+[\.、]|0\d\d|[0-9]{8,})$"
    missing = F.filter(F.array_except(F.coalesce("main", none), "said"), lambda x: ~x.rlike(noise))
    extra = F.array_except("said", F.coalesce("has", none))
    extra = F.concat(_longest_first(F.array_intersect(extra, "numbers_said")), F.array_sort(F.array_except(extra, "numbers_said")))
    return rows.select("path", extra.alias("extra"), _longest_first(missing).alias("missing"), F.col("has").isNull().alias("degraded"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("cross_block"))


def _longest_first(numbers: Column) -> Column:
    """In order of falling length, those of one length by their text."""
    keyed = F.array_sort(F.transform(numbers, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def numbers_compared(left: Column, right: Column) -> tuple[Column, Column]:
    """Number tokens only the left text has, and only the right one has."""
    a, b = F.array_distinct(t.number_tokens(left)), F.array_distinct(t.number_tokens(right))
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


# Notes and the index -----------------------------------------------------------------------------------------------

SECTIONS = ("## 作者说", "## AI 推断", "## 待确认")


def note_rules(notes: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(subject, code, status) of notes by themselves: place, sections, topics, size, confidence, open slots."""
    folder = F.split("path", "/")
    flow_dir, stage_dir = F.try_element_at(folder, F.lit(2)), F.try_element_at(folder, F.lit(3))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lacks = F.lit(False)
    for s in sections:
        lacks = lacks | ~F.col("body").contains(s)
    return rules(
        notes,
        "path",
        [
            ("axis_empty", "fail", blank("flow") | blank("stage") | blank("substage")),
            ("section_missing", "fail", lacks),
            ("flow_path", "fail", ~blank("flow") & ~F.coalesce(flow_dir == F.col("flow"), F.lit(False))),
            ("stage_path", "fail", ~blank("stage") & ~F.coalesce(t.stage_key(stage_dir) == t.stage_key(F.col("stage")), F.lit(False))),
            ("topics_empty", "fail", F.size(F.coalesce("topics", F.expr("cast(array() as array<string>)"))) <= 0),
            ("slot_open", "fail", F.size(t.slots(F.col("body"))) > 0),
            ("note_large", "warn", F.octet_length("body") > LARGE_NOTE),
            ("confidence_missing", "warn", blank("confidence")),
            ("confidence_illegal", "warn", ~blank("confidence") & ~F.col("confidence").isin(*CONFIDENCE)),
            ("confidence_low", "warn", F.col("confidence") == "low"),
        ],
    )


def unreachable_sources(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(subject, code, status): notes without sources, and sources that are no file (path)."""
    none = rules(notes, "path", [("sources_empty", "fail", F.size(F.coalesce("sources", F.expr("cast(array() as array<string>)"))) <= 0)])
    named = notes.select(F.col("path").alias("subject"), F.explode("sources").alias("source"))
    gone = named.join(files.select(F.col("path").alias("source")), "source", "left_anti").select("subject", F.lit("source_unreachable").alias("code"), F.lit("fail").alias("status"))
    return none.union(gone)


def broken_links(notes: DataFrame, extra_stems: DataFrame | None = None) -> DataFrame:
    """(path, target) of wikilinks to no note's file name."""
    stems = notes.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("target"))
    stems = stems.union(extra_stems.select("target")) if extra_stems is not None else stems
    return notes.select("path", F.explode(t.wikilinks(t.without_code(F.col("body")))).alias("target")).join(stems.distinct(), "target", "left_anti").select("path", "target")


def missing_items(required: DataFrame, present: DataFrame, code: str) -> DataFrame:
    """(subject, code, status): required paths that are not there."""
    return required.join(present.select("path"), "path", "left_anti").select(F.col("path").alias("subject"), F.lit(code).alias("code"), F.lit("fail").alias("status"))


def index_consistency(meta: DataFrame, notes: DataFrame, version: int) -> DataFrame:
    """(code, status) of an index (schema_version, notes_indexed) against the notes that are there; an empty base passes, and
    without an index (an empty ``meta``) there is nothing to judge."""
    there = notes.agg(F.count("*").alias("there"))
    # One row always: an aggregate of no row is null.
    meta = meta.agg(F.max("schema_version").alias("schema_version"), F.max("notes_indexed").alias("notes_indexed"))
    bad = F.when(F.col("schema_version") != version, "schema_version").when((F.col("there") > 0) & (F.col("notes_indexed") == 0), "index_empty").when(F.col("there") != F.col("notes_indexed"), "count_differs")
    none = F.col("schema_version").isNull()
    return meta.join(F.broadcast(there)).select(F.when(none, "no_index").otherwise(F.coalesce(bad, F.lit("ok"))).alias("code"), F.when(none, "na").when(bad.isNull(), "pass").otherwise("fail").alias("status"))


# Progress ----------------------------------------------------------------------------------------------------------


def progress(chunks: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By document (path, high, done, status), and places (note, path, start) that hit no chunk (note, path, start, code)."""
    known = chunks.select("path").distinct().withColumn("mapped", F.lit(True))
    hits = chunk_at(places, chunks.select("path", "chunk_id", "char_start", "char_end"))
    done = hits.where("chunk_id is not null").select("chunk_id").distinct().withColumn("hit", F.lit(1))
    high = F.sum(F.col("high_value").cast("bigint"))
    counted = chunks.join(done, "chunk_id", "left").groupBy("path").agg(high.alias("high"), F.sum((F.col("high_value") & F.col("hit").isNotNull()).cast("bigint")).alias("done"))
    status = F.when(F.col("high") == 0, "no_hv").when(F.col("done") == 0, "todo").when(F.col("done") < F.col("high"), "partial").otherwise("done")
    found = hits.where("chunk_id is not null").select("note", "path", "start").distinct()
    lost = places.join(found, ["note", "path", "start"], "left_anti").join(known, "path", "left")
    lost = lost.select("note", "path", "start", F.when(F.col("mapped").isNull(), "unmapped_source").otherwise("ghost_locator").alias("code"))
    return counted.withColumn("status", status), lost


def next_todo(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """The first high-value chunk, by path and place, that no note names."""
    named = chunk_at(places, chunks.select("path", "chunk_id", "char_start", "char_end")).where("chunk_id is not null").select("chunk_id")
    hit = chunks.where("high_value").join(named, "chunk_id", "left_anti").select(*chunks.columns)
    return hit.orderBy("path", "char_start").limit(1)


def progress_gate(status: DataFrame, lost: DataFrame, prefix: str = "") -> DataFrame:
    """(n_documents, n_lost, ok) of documents under a path prefix; what is lost elsewhere does not count."""
    view = status.where(F.col("path").startswith(prefix)).agg(F.count("*").alias("n_documents"))
    inside = lost.where(F.col("path").startswith(prefix)).agg(F.count("*").alias("n_lost"))
    return view.join(F.broadcast(inside)).withColumn("ok", F.col("n_lost") == 0)
