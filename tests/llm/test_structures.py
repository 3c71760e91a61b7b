"""Manifest, prefix trie and ranks against plain versions, with groups that lie in many ranges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillspark.llm import merkle, prefix_trie, ranks
from quillspark.operators import skew
from quillspark.plans.scratch import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, group string"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, node string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def many_ranges(monkeypatch):
    """Small tables are cut into as many ranges as there are shuffle partitions."""
    monkeypatch.setattr(ranks, "FEW", 8)


def test_ranks_and_sums_of_groups_that_span_ranges(spark, many_ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([None, *range(40)]), rng.randrange(-(2**63), 2**63)) for _ in range(400)] + [("hot", 7, 2**62)] * 200
    df = spark.createDataFrame(rows, "g string, o int, x bigint")
    found = ranks.ranked(df, "g", ["o", "x"], Scratch(spark, "t"), "r", ["x"]).collect()
    want = defaultdict(list)
    for g, o, x in rows:
        want[g].append((o is not None, o or 0, x))
    seen = defaultdict(list)
    for r in found:
        seen[r.g].append((r["rank"], r.o, r.x, r.x_before, r.x_sum))
    assert {g: len(v) for g, v in seen.items()} == {g: len(v) for g, v in want.items()}
    for g, v in want.items():
        total = 0
        for i, ((there, o, x), got) in enumerate(zip(sorted(v), sorted(seen[g]), strict=True), 1):
            after = ranks._wrap(total + x)
            assert got == (i, o if there else None, x, total, after)
            total = after
    assert ranks.ranked(df.limit(0), "g", ["o"], Scratch(spark, "t"), "r", ["x"]).count() == 0


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by lists in memory."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda i, t, lang, s, n: sha("".join(map(enc, (i, s, lang, n, t))))
    by = defaultdict(list)
    for i, t, lang, s, n, *_ in rows:
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by[lang].append(((i is not None, i or 0, leaf(i, t, lang, s, n)), i, leaf(i, lower(t) if changed else t, lang, s, n)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, own):
        proof = ""
        for level in levels[:-1]:
            run = list(enumerate(level))[at // 8 * 8 : at // 8 * 8 + 8]
            proof += "".join(h for k, h in run if k != at)
            own = sha("".join(own if k == at else h for k, h in run))
            at //= 8
        return proof, own

    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([k[2] for k, _, _ in sorted(by[x])]) for x in langs}
    upper = tree([trees[x][-1][0] for x in langs]) if langs else []
    out = []
    for j, x in enumerate(langs):
        for at, (k, i, other) in enumerate(sorted(by[x])):
            one, own = climb(trees[x], at, other)
            two, own = climb(upper, j, own)
            out.append((i, k[2], trees[x][-1][0], upper[-1][0], sha(one + two), own, own == upper[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    rng, rows = random.Random(5), []
    for lang, n in [(None, 3), ("", 1), ("en", 586), ("é", 64), ("ﬀ", 65), ("𝄞", 8), ("de", 9), ("x", 2), ("y", 72), ("z", 1), ("zz", 7)]:
        rows += [(rng.randrange(10**6), f"Text {rng.random()} ÄB", lang, rng.choice(["s", None, ""]), rng.choice([None, 5]), "clash", "clash") for _ in range(n)]
    rows += [(4, "Twice", "en", "s", 1, "", "")] * 20 + [(4, "Other", "en", "s", 1, "", ""), (None, None, "en", None, None, None, None), (-5, "", "en", "s", 0, None, None)]
    rng.shuffle(rows)
    return rows


def of_result(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=str)


def test_manifest_matches_plain_trees(spark, many_ranges):
    rows = manifest_rows()
    found = of_result(merkle.verified(spark.createDataFrame(rows, DOCS).repartition(3)))
    assert found == plain_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65])
def test_manifest_of_one_group(spark, n):
    rows = [(i, f"A{i}", "en", "s", 2, None, None) for i in range(n)]
    assert of_result(merkle.verified(spark.createDataFrame(rows, DOCS))) == plain_manifest(rows)


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    base = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    share = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: tuple(own.get(base(c), [])[: share[c]] + own[c][share[c] :]) for c in own}
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
    ends = defaultdict(list)
    for c, seq in whole.items():
        ends[seq].append(c)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], sha(",".join(map(str, sorted(ends[node])))))
        for node, m in members.items()
    )


def of_trie(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(-12, 60), 10**15, 10**15 + 1]:
        for turn in range(rng.choice([0, 1, 2, 5, 12, 30])):
            rows.append((c, turn if rng.random() > 0.05 else None, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "a", "bé", "", None]), 1, "x"))
    rows += [(77, t, "user", "long", 0, "") for t in range(300)] + [(78, t, "user", "long", 0, "") for t in range(299)]  # two of one line
    rows += [(1000 + c, t, "user", "copy", 0, "") for c in range(60) for t in range(4)]
    rows += [(None, 1, "user", "no conversation", 0, ""), (3, 1, "user", "twice", 0, ""), (3, 1, "user", "twice", 0, "")]
    rng.shuffle(rows)
    # Ties of turn and role go by a hash: let them not differ in text.
    held = {}
    return [(c, t, r, held.setdefault((c, t, r or ""), x), *rest) for c, t, r, x, *rest in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_a_plain_one(spark, many_ranges, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 7)
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_KEYS", 20)
    rows = conversations(seed)
    assert of_trie(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS).repartition(3))) == plain_trie(rows)


def test_trie_of_little(spark):
    for rows in ([], [(1, 0, "user", "x", 0, "")], [(2, 0, None, None, 0, "")], [(None, 0, "user", "x", 0, "")]):
        assert of_trie(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)
