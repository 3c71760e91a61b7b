"""Evidence that notes cite: parsing it, and checking that each place still is where the quote stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as t
from quillspark.operators import chunks
from quillspark.operators.quality import rules

# A citation below quoted lines, and a numbered line that names a place.
CITATION = r"> —— `§([^\n]*?)#char=(\d+)-(\d+)`"
QUOTED = rf"(?m)((?:^> (?!—— `§[^\n]*?#char=\d+-\d+`)[^\n]*\n)*)^{CITATION}"
CHECK_LINE = r"(?m)^\d+\.[ \t]+([^\n]*?)[ \t]*——[ \t]*\[char=(\d+)-(\d+)\]"


def _groups(text: Column, pattern: str, names: list[str]) -> Column:
    """Array of structs of a pattern's groups."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    return F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names, strict=True)])


def parse(notes: DataFrame) -> DataFrame:
    """(path, ord, quote, heading, start, end) of notes (path, body): the quoted lines right above a citation.

    They reach up to a line that is not quoted, or to the citation before; a citation without quoted lines is none.
    """
    found = F.posexplode(_groups(F.col("body"), QUOTED, ["lines", "heading", "start", "end"]))
    rows = notes.select("path", found.alias("ord", "e"))
    quote = F.regexp_replace(F.regexp_replace("e.lines", r"(?m)^> ", ""), r"^\s+|\s+$", "")
    return rows.select("path", "ord", quote.alias("quote"), F.col("e.heading").alias("heading"), F.col("e.start").cast("int").alias("start"), F.col("e.end").cast("int").alias("end")).where("quote <> ''")


def check_lines(notes: DataFrame) -> DataFrame:
    """(path, ord, text, start, end) of the numbered lines that name a place."""
    found = F.posexplode(_groups(F.col("body"), CHECK_LINE, ["text", "start", "end"]))
    return notes.select("path", found.alias("ord", "e")).select("path", "ord", F.col("e.text").alias("text"), F.col("e.start").cast("int").alias("start"), F.col("e.end").cast("int").alias("end"))


def locator_check(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(subject, code, status): evidence of notes (path, body, source) that is not where it says in sources (path, text), and
    check lines that point to another evidence than the one whose place shares most of their terms."""
    cited = parse(notes).join(notes.select("path", "source"), "path")
    quotes = cited.select(F.col("source").alias("path"), "quote").distinct()
    placed = chunks.locate(quotes, sources).select(F.col("path").alias("source"), "quote", "verdict", F.col("start").alias("at"), F.col("end").alias("to"))
    checked = cited.join(placed, ["source", "quote"], "left")
    found = F.coalesce(F.col("verdict").isin("unique", "normalized"), F.lit(False))
    wrong = rules(
        checked,
        "path",
        [
            ("source_unreachable", "fail", F.col("verdict").isNull()),
            ("not_recomputable", "fail", F.col("verdict").isNotNull() & ~found),
            ("span_differs", "fail", found & ((F.col("start") != F.col("at")) | (F.col("end") != F.col("to")))),
        ],
    )
    spans = cited.join(sources.select(F.col("path").alias("source"), F.col("text").alias("whole")), "source")
    spans = spans.select("path", F.col("start").alias("a"), F.col("end").alias("b"), t.query_grams(F.col("whole").substr(F.col("start") + 1, F.col("end") - F.col("start"))).alias("has"))
    lines = check_lines(notes).select("path", "ord", "start", "end", t.query_grams(F.col("text")).alias("says"))
    scored = lines.join(spans, "path").withColumn("score", F.size(F.array_intersect("says", "has")) / F.greatest(F.size("says"), F.lit(1)))
    own = F.max(F.when((F.col("a") == F.col("start")) & (F.col("b") == F.col("end")), F.col("score")))
    best = scored.groupBy("path", "ord").agg(F.max("score").alias("best"), F.coalesce(own, F.lit(-1.0)).alias("own"))
    off = rules(best, "path", [("line_points_elsewhere", "fail", (F.col("best") > 0) & (F.col("own") < F.col("best")))])
    return wrong.union(off)


def rule_levels(config: DataFrame, text: DataFrame) -> DataFrame:
    """(subject, code, status): rule levels (level) that a base's instructions (text) do not name."""
    return config.join(F.broadcast(text.select("text").limit(1))).where(~F.col("text").contains(F.col("level"))).select(F.col("level").alias("subject"), F.lit("level_not_named").alias("code"), F.lit("fail").alias("status"))


def spot_verdict(checked: DataFrame, group: str, least: float = 0.95) -> DataFrame:
    """(group, n, good, verdict) of a spot check's rows (group, ok): a share below ``least`` means to roll back."""
    counted = checked.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("ok"), F.lit(False)).cast("bigint")).alias("good"))
    return counted.withColumn("verdict", F.when(F.col("good") / F.col("n") < least, "roll_back").otherwise("pass"))


def low_value_sample(rows: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """About so many in a hundred of the low-value chunks, by a hash of their key: two runs draw the same."""
    return rows.where(~F.col("high_value")).where(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(100)) < percent)


def merged_procedures(units: DataFrame) -> DataFrame:
    """(doc_id, goal, id, steps, evidence, conflict): procedures of one document and goal as one, steps by their order.

    Steps of one number that say different things are a conflict, and all stay; equal ones count once. All evidence stays.
    """
    rows = units.where("type = 'procedure'")
    steps = rows.select("doc_id", "goal", F.explode("steps").alias("s")).select("doc_id", "goal", "s.order", "s.action").distinct()
    joined = steps.groupBy("doc_id", "goal").agg(F.array_sort(F.collect_list(F.struct("order", "action"))).alias("steps"), (F.count("order") > F.count_distinct("order")).alias("conflict"))
    whole = rows.groupBy("doc_id", "goal").agg(F.min("id").alias("id"), F.flatten(F.collect_list("evidence")).alias("evidence"))
    return whole.join(joined, ["doc_id", "goal"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def unit_counts(units: DataFrame) -> DataFrame:
    """(by, value, n): units by type, by confidence and by status, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("type", "confidence", "status")]))
    return units.select(each.alias("x")).select("x.by", "x.value").groupBy("by", "value").agg(F.count("*").alias("n"))
