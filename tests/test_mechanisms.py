"""As-of joins, the folder source, bucketed merges and the automaton of words, against plain versions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import asof, buckets, chunks, quality, tagging
from quillspark.sources import folders, notes


def test_as_of_matches_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(asof, "RANGE", 40)  # one key in many ranges
    rng = random.Random(2)
    starts = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(0, 400, 3)]), i) for i in range(150)]
    points = [(rng.choice(["hot", "hot", "a", "none", None]), rng.choice([None, *range(-5, 420)]), i) for i in range(200)] + [("hot", 7, 1)] * 2
    found = asof.as_of(spark.createDataFrame(points, "k string, at int, i int"), spark.createDataFrame(starts, "k string, s int, i int"), "k", "at", "s")

    def last(k, at):
        held = [(s, j) for kk, s, j in starts if kk is not None and kk == k and s is not None and at is not None and s <= at]
        return max(held) if held else None

    got = sorted(((r.k, r.at, r.i, (r.held.s, r.held.i) if r.held else None) for r in found.collect()), key=str)
    assert got == sorted(((k, at, i, last(k, at)) for k, at, i in points), key=str)


def test_chunks_of_many_places_take_linear_time(spark):
    """One document of 100,000 chunks and as many places: comparing them all would be 10**10 pairs."""
    n = 100_000
    cut = spark.range(n).select(F.lit("d").alias("path"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("heading"), (F.col("id") * 10).alias("char_start"), (F.col("id") * 10 + 8).alias("char_end"), F.lit(True).alias("high_value"))
    places = spark.range(n).select(F.lit("d").alias("path"), (F.col("id") * 10 + F.col("id") % 10).alias("start"))
    began = time.perf_counter()
    found = chunks.chunk_at(places, cut)
    assert found.where("chunk_id = cast(start div 10 as string)").count() == n * 8 // 10 and found.where("chunk_id is null").count() == n * 2 // 10
    assert time.perf_counter() - began < 60


def tree(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of {name}")


def test_folder_source_sees_all_names(spark, tmp_path, monkeypatch):
    names = ["a.md", "_meta/y.md", "_meta/_z.md", "x/_in/b c%20d.md", "x/y/z/deep.TXT", "x/y/z/_w/+.md", "no_ending", "é/ü.md"]
    hidden = [".git/c.md", "x/.h/i.md", ".trash/t.md", "__MACOSX/m.md", ".dot.md"]
    tree(tmp_path, names + hidden)
    for least in (64, 2):  # all folders listed one by one, or some of them by the executors
        monkeypatch.setattr(folders, "LEAST", least)
        assert sorted(r.path for r in notes.files(spark, str(tmp_path)).collect()) == sorted(names)
    assert {r.path: r.text for r in notes.texts(spark, f"file://{tmp_path}").collect()} == {n: f"text of {n}" for n in names if n.endswith(".md")}
    assert notes.files(spark, str(tmp_path / "none")).count() == 0


def test_folder_source_takes_filters_over(spark, tmp_path):
    tree(tmp_path, ["a.md", "b.md", "c/d.txt", "c/a.md"])
    rows = folders.load(spark, str(tmp_path), content=True)
    for test, want in (
        (F.col("ext") == "txt", {"c/d.txt"}), (F.col("path").endswith(".md"), {"a.md", "b.md", "c/a.md"}), (F.col("name").isin("a.md", "d.txt"), {"a.md", "c/a.md", "c/d.txt"}),
        (F.col("path").startswith("c/") & (F.col("ext") != "md"), {"c/d.txt"}), ((F.col("ext") == "md") & (F.col("size") > 13), {"c/a.md"}),
    ):
        assert {r.path for r in rows.where(test).collect()} == want
    reader = folders.FolderReader(str(tmp_path), True)
    kept = list(reader.pushFilters([folders.EqualTo(("ext",), "md"), folders.Not(folders.StringStartsWith(("path",), "c/")), folders.EqualTo(("size",), 3)]))
    assert kept == [folders.EqualTo(("size",), 3)]
    opened = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert {r["path"] for r in opened} == {"a.md", "b.md"}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    folder, rng, live = str(tmp_path / "t"), random.Random(3), {}
    schema = "path string, arrived int, title string"

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, found in os.walk(folder) for f in found if f.endswith(".parquet")}

    def rows():
        return {(r.path, r.arrived, r.title) for r in buckets.read(spark, folder).collect()}

    assert buckets.read(spark, folder) is None
    for number in range(4):
        batch = [(rng.choice([None, *(f"p{i}" for i in range(60))]), number - rng.randrange(2), f"t{rng.randrange(99)}") for _ in range(40 if not number else 4)]
        before = files()
        touched = buckets.merge(spark.createDataFrame(batch, schema), folder, "path", "arrived", number, buckets=16)
        assert len(touched) <= 5 or not number
        after = files()
        assert before.items() <= after.items() and len(after) - len(before) == len(touched)
        for p, a, t in batch:
            live[p] = max(live.get(p, (-9, "")), (a, t))
        assert rows() == {(p, a, t) for p, (a, t) in live.items()}
    # The same batch again, under its own number.
    assert buckets.merge(spark.createDataFrame(batch, schema), folder, "path", "arrived", 3) == [] and files() == after
    assert buckets.merge(spark.createDataFrame([], schema), folder, "path", "arrived", 4) == []
    buckets.vacuum(spark, folder)
    assert rows() == {(p, a, t) for p, (a, t) in live.items()} and len(files()) == len({b for b in range(16)} & {int(f.split("bucket=")[1].split("/")[0]) for f in files()})


@pytest.mark.parametrize("lot", [1 << 20, 40])
def test_automaton_tags_as_the_plan_does(spark, monkeypatch, lot):
    rng = random.Random(4)
    words = tagging.Vocabulary(
        canon={d: [f"{d}{i}" for i in range(6)] + ["ab", "ba"] for d in (*tagging.TAGGED, "sources")}, synonyms={"ab": ["bab", "a"], "types1": ["ABAB", "é"], "tools2": ["", "b/b"]},
        implies={"projects1": {"domains": ["ab"]}}, tools_of=("ba", ["tools2"]), source_priority=["ba", "sources1"],
    )
    paths = ["".join(rng.choice(["a", "b", "B", "/", "é", "types1", "PROJECTS1", "sources1", "x"]) for _ in range(rng.randrange(6))) for _ in range(200)]
    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    plan = sorted(map(str, tagging.tag_paths(rows, words).collect()))
    monkeypatch.setattr(tagging, "PLANNED", 0)
    monkeypatch.setattr(tagging, "AUTOMATON", lot)
    assert sorted(map(str, tagging.tag_paths(rows, words).collect())) == plan


def test_totals_are_taken_while_rules_are_written(spark, tmp_path):
    """One job writes the rows and counts them: each row is made once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [("a", "x", "fail"), ("b", "y", "warn"), ("c", "y", "warn"), ("d", "z", "other"), (None, None, None)]
    found = spark.createDataFrame(rows, "subject string, code string, status string").mapInArrow(count, "subject string, code string, status string")
    totals = quality.write_rules(found, str(tmp_path / "rules"))
    assert made.value == 5 and {k: n for k, n in totals.items() if n} == {"rows": 5, "fail": 1, "warn": 2}
    assert spark.read.parquet(str(tmp_path / "rules")).count() == 5
    assert quality.write_rules(found.limit(0), str(tmp_path / "none"))["rows"] == 0


def test_a_hundred_thousand_words(spark):
    words = tagging.Vocabulary(canon={"domains": [f"word{i}x" for i in range(100_000)], "types": ["guide"]})
    rows = spark.range(2000).select(F.concat(F.lit("a/WORD"), (F.col("id") * 50).cast("string"), F.lit("x/guide.md")).alias("path"))
    found = tagging.tag_paths(rows, words)
    assert found.where("domains = array(concat('word', regexp_extract(path, '(\\\\d+)', 1), 'x')) and types = array('guide')").count() == 2000
