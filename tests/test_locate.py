"""Places of quotes against plain search, and many quotes of one long text."""

import random
import time
import unicodedata

import pytest

from quillspark.functions import text as t
from quillspark.operators import chunks


def norm(text):
    return "".join(c for c in text if not (c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] in "PS"))


def plain(quote, text):
    if not quote or text is None:
        return ("missing", 0, None, None)
    at = [i for i in range(len(text)) if text.startswith(quote, i)]
    if at:
        return ("unique" if len(at) == 1 else "ambiguous", len(at), at[0], at[0] + len(quote))
    kept, bare = [i for i, c in enumerate(text) if norm(c)], norm(quote)
    first = norm(text).find(bare) if bare else -1
    return ("normalized", 0, kept[first], kept[first + len(bare) - 1] + 1) if first >= 0 else ("missing", 0, None, None)


@pytest.mark.parametrize("lot", [4096, 3])
def test_places_match_plain_search(spark, monkeypatch, lot):
    monkeypatch.setattr(chunks, "LOT", lot)
    rng = random.Random(lot)
    letters = ["a", "b", " ", ".", "引", "😀", "\n", "+", "é"]
    texts = {f"d{i}": "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for i in range(12)} | {"null": None, "empty": ""}
    asked = [(p, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 4)))) for p in texts for _ in range(25)]
    asked += [("d0", None), ("d0", "a"), ("d0", "a"), ("none", "a"), (None, "a"), ("d1", "\\E(")]
    found = chunks.locate(spark.createDataFrame(asked, "path string, quote string"), spark.createDataFrame([(p, x, "clash") for p, x in texts.items()], "path string, text string, quote string"))
    want = sorted(((p, q, *plain(q, texts[p])) for p, q in asked if p in texts), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_norm_is_that_of_columns(spark):
    # Without code points that the JVM's version of Unicode does not know yet (currency signs from 20C0 on).
    odd = "".join(chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x20C0), *range(0x2100, 0x2400), *range(0x3000, 0x3100), 0x1F600, 0xFF0C])
    row = spark.createDataFrame([(odd,)], "x string").select(t.norm("x").alias("n")).first()
    assert chunks.UNMARKED.sub("", odd) == row.n == "".join(m[0] for m in chunks.MARKED_CHAR.finditer(odd))


def test_many_quotes_of_one_text(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    quotes = [("d", text[i : i + 40]) for i in (rng.randrange(len(text) - 40) for _ in range(5000))] + [("d", f"absent {i}") for i in range(1000)]
    began = time.perf_counter()
    rows = chunks.locate(spark.createDataFrame(quotes, "path string, quote string"), spark.createDataFrame([("d", text)], "path string, text string")).collect()
    assert len(rows) == 6000 and all(text[r.start : r.end] == r.quote for r in rows if r.n_places) and sum(r.verdict == "missing" for r in rows) == 1000
    assert time.perf_counter() - began < 60
