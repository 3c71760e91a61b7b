"""Set joins against all pairs, and how few pairs meet."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search, similar, skew
from quillspark.plans.scratch import Scratch

SETS = "id string, members array<string>"


def brute(asked, kept, of_asked, of_kept, least):
    out = set()
    for i, x in asked:
        for j, y in kept:
            a, b = {m for m in x if m}, {m for m in y if m}
            n = len(a & b)
            if a and b and n and (n / len(a) >= of_asked or n >= least and n / len(b) >= of_kept):
                out.add((i, j, n))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_sharing_matches_all_pairs(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 8)
        monkeypatch.setattr(skew, "HOT_KEYS", 50)
    rng = random.Random(8)

    def sets(prefix, n):
        # A few members are in nearly all sets.
        return [(f"{prefix}{i}", [f"m{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(0, 14))] + rng.choice([[], ["m1"], [None]])) for i in range(n)]

    asked, kept = sets("a", 150), sets("k", 200) + [("copy1", ["m1", "m2"]), ("copy2", ["m2", "m1"])]
    for shares in ((0.5, 0.35, 2),) if hot else ((0.5, 0.35, 2), (0.01, 0.35, 3)):
        found = similar.sharing(spark.createDataFrame(asked, SETS), spark.createDataFrame(kept, SETS), *shares, Scratch(spark, "t"))
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(asked, kept, *shares)
    empty = spark.createDataFrame([], SETS)
    assert similar.sharing(empty, spark.createDataFrame(kept, SETS), 0.5, 0.35, 2, Scratch(spark, "t")).count() == 0
    assert similar.sharing(spark.createDataFrame(asked, SETS), empty, 0.5, 0.35, 2, Scratch(spark, "t")).count() == 0


def test_common_members_bring_few_pairs(spark):
    """Texts that share their four common words and differ in two rare ones: all pairs have four in common."""
    rng = random.Random(9)
    rows = [(str(i), ["what", "is", "the", "price", *[f"rare{rng.randrange(4000)}" for _ in range(8)]]) for i in range(1500)]
    sets, scratch = spark.createDataFrame(rows, SETS), Scratch(spark, "t")
    frequency = sets.select(F.explode(F.array_distinct("members")).alias("member")).groupBy("member").agg(F.count("*").alias("n"))
    ordered = similar._ordered(sets, frequency, scratch, "sets")
    met = similar.candidates(ordered, ordered, 0.5, 0.5, 2, 18_000).count()
    assert 1500 <= met < 0.03 * 1500 * 1500
    assert {tuple(r) for r in similar.sharing(sets, sets, 0.5, 0.5, 2, scratch).collect()} == brute(rows, rows, 0.5, 0.5, 2)


def test_hook_matches_of_copies_and_odd_texts(spark):
    hooks = [("p1", "how do pumps work"), ("p2", "how do pumps work"), ("p1", "how do pumps work"), ("p3", ""), ("p4", None), ("p5", "ump"), ("p6", "unrelated thing entirely")]
    queries = [(1, "pumps work well"), (2, "pumps work well"), (3, ""), (4, None), (5, "nothing here"), (6, "ated thin")]
    found = search.hook_matches(spark.createDataFrame(hooks, "path string, hook string"), spark.createDataFrame(queries, "query_id int, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted([(q, p, h, n) for q in (1, 2) for p, h, n in [("p1", "how do pumps work", 2), ("p2", "how do pumps work", 2), ("p5", "ump", 0)]] + [(6, "p6", "unrelated thing entirely", 0)])


def test_hook_matches_take_no_square_of_common_terms(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    texts = [f"what is the price of {' '.join(rng.sample(words, 7))}" for _ in range(2000)]
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "path string, hook string").repartition(4)
    began = time.perf_counter()
    found = search.hook_matches(rows, rows.select(F.col("path").alias("query_id"), F.col("hook").alias("text")))
    assert found.where("query_id = path").count() == 2000
    assert time.perf_counter() - began < 60
