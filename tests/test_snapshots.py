"""Trees of folder digests, their differences, and verdicts on a source folder."""

import random

from quillspark.operators import snapshots

FILE = "path string, size bigint, sha256 string"


def test_tree_diff_matches_comparing_all_files(spark):
    rng = random.Random(7)
    old = {"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + f"/f{i % 40}.md": (5, f"h{i}") for i in range(150)} | {"root.md": (1, "r"), "same/one.md": (1, "s"), "same/two.md": (2, None)}
    new = dict(old)
    for p in rng.sample(sorted(set(old) - {"same/one.md", "same/two.md"}), 30):
        new.pop(p) if rng.random() < 0.4 else new.update({p: (9, rng.choice(["changed", None]))})
    new |= {"a/new.md": (1, "n"), "fresh/deep/er/new.md": (1, "n")}
    before, after = (spark.createDataFrame([(p, *x) for p, x in s.items()] + [(None, 1, "x")], FILE) for s in (old, new))
    want = {(p, "added") for p in new.keys() - old.keys()} | {(p, "deleted") for p in old.keys() - new.keys()}
    want |= {(p, "unreadable" if new[p][1] is None else "modified") for p in new.keys() & old.keys() if new[p][1] is None or new[p][1] != old[p][1]}
    assert {tuple(r) for r in snapshots.diff(before, after).collect()} == want
    trees = snapshots.tree(before), snapshots.tree(after)
    changed = {r.folder for r in snapshots.changed_folders(*trees).collect()}
    assert "" in changed and "same" not in changed and {"fresh", "fresh/deep", "fresh/deep/er"} <= changed
    root = trees[0].where("folder = ''").first()
    assert (root.parent, root.n_files, root.size) == (None, len(old), sum(x[0] for x in old.values()))
    assert snapshots.diff(before, before).where("change <> 'unreadable'").isEmpty() and snapshots.changed_folders(trees[0], trees[0]).isEmpty()
    assert snapshots.tree(before.limit(0)).isEmpty()


def test_verdicts(spark):
    changes = spark.createDataFrame([("a", "deleted"), ("b", "modified"), ("c", "added"), ("d", "added"), ("e", "unreadable")], "path string, change string")
    was, now = (spark.createDataFrame(x, "kind string, n bigint") for x in ([("film", 3), ("sound", 1), ("gone", 2)], [("film", 3), ("sound", 4), ("new", 1)]))
    media = {("media_changed:sound", "warn", 3), ("media_changed:gone", "warn", -2), ("media_changed:new", "warn", 1)}

    def rows(x, *more):
        return {tuple(r) for r in snapshots.verdict(x, *more).collect()}

    kept = {("source_deleted", "fail", 1), ("source_modified", "fail", 1), ("unreadable", "warn", 1)} | media
    assert rows(changes, was, now, ["md", "txt"], ["txt", "md"]) == kept | {("source_added", "warn", 2)}
    for listed in (["md"], None):  # another list, or none: new files are pardoned, nothing else
        assert rows(changes, was, now, listed, ["md", "txt"]) == kept | {("added_pardoned", "info", 2), ("list_changed", "warn", 2 - len(listed or []))}
    assert snapshots.overall(snapshots.verdict(changes, was, now, ["md"], ["md"])).first().status == "fail"
    assert snapshots.overall(snapshots.verdict(changes.where("change = 'added'"), was, was, ["md"], ["md"])).first().status == "warn"
    assert snapshots.overall(snapshots.verdict(changes.limit(0), was, was, ["md"], ["md"])).first().status == "pass"


def test_media_by_extension(spark):
    files = spark.createDataFrame([("a/x.MP4",), ("y.mp3",), ("z.tar.mp3",), ("n",), ("d.x/n",), (None,)], "path string")
    assert {tuple(r) for r in snapshots.media_counts(files, {"mp4": "film", "mp3": "sound"}).collect()} == {("film", 1), ("sound", 2)}
