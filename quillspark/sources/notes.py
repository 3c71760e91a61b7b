"""Readers and writers: markdown notes with frontmatter, file inventories, JSON lines, tag baselines, web pages, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import text as t
from quillspark.sources import folders

# Fixed values.
AGGREGATE_PAGES = ("_流程.md", "_总览.md", "_主题地图.md", "_提示词资产.md", "_模板.md")
LIST_FIELDS = ("domains", "forms", "tools", "types", "projects", "topics", "q_hooks", "sources", "source_locator")
TEXT_FIELDS = ("title", "flow", "stage", "substage", "source_kind", "confidence")
SCHEMA_VERSION = 4
UNIT_SCHEMA = (
    "id string, doc_id string, chunk_id string, topic_ids array<string>, type string, confidence string, status string, inference string, text string, name string, definition string, "
    "subject string, predicate string, object string, relation_type string, goal string, steps array<struct<order:int,action:string,locator:string>>, question string, answer string, "
    "sources array<string>, positions array<struct<source:string,text:string,locator:string>>"
)
EVIDENCE = "array<struct<file:string,locator:string,quote:string>>"


class EmptyInput(ValueError):
    """Nothing to build from: an empty result would look like success."""


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below a folder but hidden ones and system folders."""
    return folders.load(spark, root).select("path", "size")


def texts(spark: SparkSession, root: str, ending: str = ".md") -> DataFrame:
    """(path, text) of text files below a folder, newlines as \\n; only files with this ending are opened."""
    rows = folders.load(spark, root, content=True).where(F.col("path").endswith(ending))
    return rows.select("path", t.newlines(F.decode("content", "UTF-8")).alias("text"))


def front(text: Column) -> Column:
    """What stands between the marks at a note's head."""
    return F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")


def field(head: Column, name: str) -> Column:
    """A field's text on its own line, without quotes and a trailing comment."""
    raw = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    quoted = raw.rlike(r"""^(["']).*\1$""")
    return t.strip_quotes(F.when(quoted, raw).otherwise(F.trim(F.regexp_replace(raw, r"(^|[ \t])#.*$", ""))))


def list_field(head: Column, name: str) -> Column:
    """A field's list: in brackets, with commas of either width, or as a block of dashed lines."""
    block = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(?:#.*)?\n((?:[ \t]+-[^\n]*(?:\n|$))+)", 1)
    lines = F.transform(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != ""), lambda x: t.strip_quotes(F.regexp_replace(x, r"^[ \t]*-[ \t]*", "")))
    inline = F.regexp_replace(field(head, name), r"^\[|\]$", "")
    items = F.filter(F.transform(F.split(inline, "[,，]"), t.strip_quotes), lambda x: x != "")
    return F.when(block != "", F.filter(lines, lambda x: x != "")).otherwise(items)


def parse_notes(rows: DataFrame) -> DataFrame:
    """Notes from (path, text): one column for each field; pages that gather others and texts without a head are left out."""
    kept = rows.where(~F.substring_index("path", "/", -1).isin(*AGGREGATE_PAGES)).withColumn("_head", front(F.col("text"))).where(F.col("_head") != "")
    head, content = F.col("_head"), body(F.col("text"))
    updated, created = field(head, "updated"), field(head, "created")
    return kept.select(
        "path", *[field(head, f).alias(f) for f in TEXT_FIELDS], *[list_field(head, f).alias(f) for f in LIST_FIELDS],
        F.when(updated != "", updated).otherwise(created).alias("updated"), (F.lower(field(head, "stale")) == "true").alias("stale"), t.summary(content).alias("summary"), content.alias("body"),
    )


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    return parse_notes(texts(spark, root))


def indexable(notes: DataFrame) -> DataFrame:
    """Notes with the columns that are indexed: title, body, dimtext and qhooks."""
    dims = F.concat_ws(" ", *[F.concat_ws(" ", d) for d in ("domains", "forms", "tools", "types", "projects", "topics")])
    return notes.withColumn("dimtext", dims).withColumn("qhooks", F.concat_ws(" ", "q_hooks"))


def tag_sniff(rows: DataFrame) -> DataFrame:
    """(tag, n) of tag lines among the first forty lines of (path, text)."""
    lines = F.filter(F.slice(F.split("text", "\n"), 1, 40), lambda x: x.rlike(r"^tags:\s*"))
    tags = rows.select(F.explode(lines).alias("line")).select(F.explode(F.split(F.regexp_replace("line", r"^tags:\s*\[?|\]?\s*$", ""), "[,，;；]")).alias("tag")).select(t.strip_quotes(F.col("tag")).alias("tag"))
    return tags.where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def tag_baseline(spark: SparkSession, path: str, column: str = "主题分类") -> DataFrame:
    """(tag, n) of a CSV file's column of tags divided by semicolons."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    column = column if column in rows.columns else next(c for c in rows.columns if c.startswith("主题"))
    tags = rows.select(F.explode(F.split(F.col(column), "[;；]")).alias("tag")).select(F.trim("tag").alias("tag"))
    return tags.where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def read_units(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Units from JSON lines; evidence may be one object or a list. Bad lines are kept in ``_corrupt``, or end the job if strict."""
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    schema = UNIT_SCHEMA if strict else f"{UNIT_SCHEMA}, _corrupt string"
    parsed = lines.select(F.from_json("value", schema, mode).alias("u"), F.get_json_object("value", "$.evidence").alias("e"))
    many = F.from_json("e", EVIDENCE)
    one = F.array(F.from_json("e", "struct<file:string,locator:string,quote:string>"))
    return parsed.select("u.*", F.when(F.col("e").startswith("["), many).when(F.col("e").startswith("{"), one).otherwise(F.expr(f"cast(array() as {EVIDENCE})")).alias("evidence"))


def html_text(page: Column) -> Column:
    """A page's visible text by patterns alone: no scripts, styles, comments or tags, the common references decoded."""
    out = page
    for hidden in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>", r"(?s)<!--.*?-->"):
        out = F.regexp_replace(out, hidden, " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def convert(documents: DataFrame, converters: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, status, sha12, text) of binary documents (path, content), by converters for their extensions.

    A converter is any function from bytes to text, such as a wrapper of an installed library; what has none is told.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                way = converters.get(path.rpartition(".")[2].lower())
                text = way(bytes(content)) if way else None
                rows.append((path, "converted" if way else "skipped", hashlib.sha256(bytes(content)).hexdigest()[:12], text))
            yield pd.DataFrame(rows, columns=["path", "status", "sha12", "text"])

    return documents.select("path", "content").mapInPandas(run, "path string, status string, sha12 string, text string")


# Sinks -------------------------------------------------------------------------------------------------------------


def write_index(notes: DataFrame, folder: str) -> None:
    """Notes, postings, lengths, terms and meta as tables, which ``search.open_index`` reads; a full rebuild, so notes that are gone leave nothing behind."""
    from quillspark.operators import search

    if notes.isEmpty():
        raise EmptyInput("no notes to index")
    ready = indexable(notes)
    ready.write.mode("overwrite").parquet(f"{folder}/note")
    search.build_index(ready, folder)
    ready.agg(F.lit(SCHEMA_VERSION).alias("schema_version"), F.count("*").alias("notes_indexed")).write.mode("overwrite").parquet(f"{folder}/meta")


def with_hooks(text: Column, hooks: Column) -> Column:
    """A note's text with its question list replaced, or added at the end of its head."""
    block = F.concat(F.lit("q_hooks:"), F.when(F.size(hooks) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(hooks, lambda h: F.concat(F.lit('  - "'), h, F.lit('"'))), "\n"))).otherwise(F.lit(" []")))
    head = F.regexp_replace(front(text), r"(?m)^q_hooks:[^\n]*(?:\n[ \t]+-[^\n]*)*\n?", "")
    head = F.regexp_replace(head, r"\n+$", "")
    return F.when(front(text) != "", F.concat(F.lit("---\n"), head, F.lit("\n"), block, F.lit("\n---\n"), body(text))).otherwise(text)


def append_log(rows: DataFrame, folder: str) -> None:
    """JSON lines, added to what is there."""
    rows.write.mode("append").json(folder)


def report(sections: DataFrame) -> DataFrame:
    """(name, text): markdown of lines (name, ord, line), in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return sections.groupBy("name").agg(F.concat_ws("\n", lines).alias("text"))
