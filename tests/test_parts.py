"""Texts are taken apart in tasks of a bounded share of them, however few files they come from."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search, segments
from quillspark.plans import adapter


@pytest.fixture
def notes(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_BYTES", 2000)
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("number"), (F.col("id") * k).cast("string"))))
    return spark.range(0, 200, 1, 1).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("path"), words.alias("body"))


def test_topic_words_by_size(notes):
    text = notes.agg(F.sum(F.length("body"))).first()[0]
    found = adapter.topic_words(notes)
    assert found.rdd.getNumPartitions() >= text / 2000 and found.count() == 200


def test_index_by_size(spark, notes, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 1)
    text, at = notes.agg(F.sum(F.length("body"))).first()[0], f"{tmp_path}/index"
    now = segments.update(spark, at, notes)
    files = {t: len([n for n in os.listdir(f"{at}/{now.segments[0].name}/{t}") if n.endswith(".parquet")]) for t in ("forward", "posting")}
    assert min(files.values()) >= text / 2000 / 2  # parts that no block falls to leave no file
