"""Prefix-target expansion of conversations: one training example for each assistant turn.

A turn is written as ``<s>[INST]role[/INST]text</s>``. Control strings inside a role or a text are broken by a
backslash after their first character and backslashes are doubled, so what was written can be read back exactly. An
example is the conversation up to one assistant turn; its loss mask, a range of code points, covers that turn's text
only. A conversation whose last turn is not an assistant's also gives one example without trainable text, so that no
turn is lost.

All of it is built-in functions: turns are gathered once by conversation, and the examples of a conversation are
exploded from its own row.

Edge cases: null roles and texts count as empty; turns with equal numbers are ordered by role and text, null numbers
come first; repeated rows are turns of their own; a null conv_id is a conversation like others; an empty table gives no
examples; further columns, also ones named like the result's, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
EXAMPLES = ("conv_id", "example", "n_turns", "text", "loss_start", "loss_end")


def escape(text: Column) -> Column:
    """The text without control strings; ``unescape`` gives it back."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.when(doubled.rlike(CONTROL), F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")).otherwise(doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """One row for each example: (conv_id, example, n_turns, text, loss_start, loss_end), the mask in code points from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(OPEN + HEAD), escape(t["role"]), F.lit(TAIL)).alias("head"), escape(t["text"]).alias("body")),
    )
    whole = whole.select("conv_id", written.alias("turns"))
    numbered = whole.select("conv_id", "turns", F.posexplode("turns").alias("k", "t")).where(F.col("t.reply") | (F.col("k") == F.size("turns") - 1))
    before = F.concat_ws("", F.transform(F.slice("turns", 1, F.col("k")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))))
    context = F.concat(before, F.col("t.head"))
    pieces = numbered.select("conv_id", F.col("k").alias("example"), context.alias("context"), F.col("t.body").alias("body"), F.col("t.reply").alias("reply"))
    start = F.length("context").cast("bigint")
    end = F.length("context") + F.length("body")
    return pieces.select(
        "conv_id", "example", (F.col("example") + 1).cast("bigint").alias("n_turns"),
        F.concat("context", "body", F.lit(CLOSE)).alias("text"),
        F.when(F.col("reply"), start).otherwise(end).cast("bigint").alias("loss_start"), end.cast("bigint").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) of the turns in an example."""
    turns = F.split(text, "\\Q" + CLOSE + "\\E", -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    body = F.lit(len(OPEN + HEAD) + 1)

    def turn(t: Column) -> Column:
        parts = F.split(t.substr(body, F.length(t)), "\\Q" + TAIL + "\\E", -1)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(turns, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """By conversation, read back from its examples: turns from the longest, trained text from the masks of all."""
    masked = F.col("text").substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    trained = F.struct("example", unescape(masked).alias("text"))
    gathered = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"), F.array_sort(F.collect_list(trained)).alias("trained"), F.sum(F.length("text")).cast("bigint").alias("formatted_chars")
    )
    loss = F.concat_ws("", F.transform("trained", lambda t: t["text"]))
    read = gathered.select("conv_id", read_turns(F.col("longest")).alias("turns"), loss.alias("loss"), "formatted_chars")
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


DIGEST_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    20
      + length(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3_\2\4', 'g'))
      + length(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3_\2\4', 'g')) AS chars
  FROM rows
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM numbered
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
