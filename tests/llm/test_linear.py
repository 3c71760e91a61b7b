"""Work that follows the length of the text, and results of shards and leaks against plain versions."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, secrets, sharding
from quillspark.plans.scratch import Scratch


def seconds(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def test_tiling_of_repeated_words_is_linear():
    def tile(n, period):
        words = np.tile(np.arange(5, 5 + period, dtype=np.uint64), n // period)
        assert sum(m[3] for m in decontamination.tiles(words[: n // 4], [words], 5)) == len(words[: n // 4])

    for period in (1, 7):
        tile(2000, period)
        short, long = seconds(tile, 10_000, period), seconds(tile, 40_000, period)
        assert long < 10 * max(short, 0.2)


def test_places_of_many_secrets_are_linear(spark):
    rng = random.Random(3)

    def scan(n):
        text = " ".join("%032x" % rng.getrandbits(128) for _ in range(n))
        row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
        assert row.n_hex == n and row.spans.startswith("hex:0:32,hex:33:65")

    scan(10)
    base, short, long = seconds(scan, 10), seconds(scan, 2500), seconds(scan, 10_000)
    assert long - base < 10 * max(short - base, 1.0)


def plain_directory(rows, limit):
    """Depth of each hash's leaf: a bucket over the limit splits on its next bit."""
    found = {}

    def split(own, depth):
        if sum(n for _, n in own) <= limit or depth == 64:
            found.update({h: depth for h, _ in own})
        else:
            for bit in (0, 1):
                part = [(h, n) for h, n in own if (h % 2**64) >> (63 - depth) & 1 == bit]
                if part:
                    split(part, depth + 1)

    split(rows, 0)
    return found


@pytest.mark.parametrize("limit", [30, 64, 1000])
def test_shards_are_those_of_a_plain_directory(spark, limit):
    rng = random.Random(limit)
    docs = [(i, "x" * rng.choice([0, 1, 7, 15, 30])) for i in range(150)] + [(900, "y" * 32)] * 2 + [(901, "z" * 33), (902, None)]
    df = spark.createDataFrame([(*d, "kept", i) for i, d in enumerate(docs)], "doc_id bigint, text string, Kind string, Page int").repartition(3)
    hashed = [(r._h, r.n_bytes) for r in sharding._hashed(df).collect()]
    want = plain_directory(hashed, limit)
    sharding.write_shards(df, path := Scratch(spark, "t").path("shards"), limit)
    back = sharding.read_shards(spark, path, df)
    assert "Page" not in back.columns and back.columns.count("page") == 1  # the result's own column takes the place of one that differs by case
    got = back.withColumn("_h", F.xxhash64(F.lit(11), "doc_id", "text")).collect()
    assert sorted((r._h, r.depth) for r in got) == sorted((h, want[h]) for h, _ in hashed)
    assert all(r.shard == format(r._h % 2**64, "064b")[: r.depth] and r.Kind == "kept" for r in got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard, r.page] += r.n_bytes
        assert r.oversized == (r.n_bytes > limit)
    assert all(n <= limit for (s, p), n in sizes.items() if not any(r.oversized for r in got if (r.shard, r.page) == (s, p)))


def brute_coverage(item, doc, least):
    free_a, free_b, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = max(((n, -a, -b) for a in range(len(item)) for b in range(len(doc)) if (n := run(item, doc, a, b, free_a, free_b)) >= least), default=None)
        if not best:
            return covered / len(item)
        n, a, b = best[0], -best[1], -best[2]
        free_a[a : a + n], free_b[b : b + n] = [False] * n, [False] * n
        covered += n


def run(item, doc, a, b, free_a, free_b):
    n = 0
    while a + n < len(item) and b + n < len(doc) and free_a[a + n] and free_b[b + n] and item[a + n] == doc[b + n]:
        n += 1
    return n


def test_leaks_match_brute_force(spark):
    """Small alphabets and many items, so that seeds are shared by nearly all; the whole operator with its filter and joins."""
    rng = random.Random(11)
    items = [[f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 14))] for _ in range(14)]
    docs = [[f"w{rng.randrange(5)}" for _ in range(rng.randrange(0, 30))] for _ in range(20)] + [i + ["x"] for i in items[:4]]
    found = decontamination.leaks(
        spark.createDataFrame([(i, " ".join(d), "c") for i, d in enumerate(docs)], "doc_id bigint, text string, row string"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"),
    ).collect()
    want = {}
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            covered = brute_coverage(x, d, min(len(x), decontamination.SEED))
            if covered >= decontamination.COVERAGE:
                want[i, j] = covered
    assert {(r.doc_id, r.item_id): r.coverage for r in found} == pytest.approx(want)
    clean = decontamination.keep_clean(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(None, "w0")], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i in range(len(docs)) if not any(k[0] == i for k in want)} | {None}
