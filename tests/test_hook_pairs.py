from quillspark.operators import search
from quillspark.plans.scratch import Scratch


def test_pairs_hold_no_texts(spark, monkeypatch):
    """A file of pairs of repeated texts is small, but not what a broadcast join makes of it."""
    kinds, store = {}, Scratch.store

    def told(self, frame, table):
        kinds[table] = dict(frame.dtypes)
        return store(self, frame, table)

    monkeypatch.setattr(Scratch, "store", told)
    hooks = spark.createDataFrame([("a", "how is a pump repaired"), ("b", "pump"), ("c", None)], "path string, hook string")
    asked = spark.createDataFrame([(1, "repaired the pump"), (2, "ump"), (3, None)], "query_id int, text string")
    got = sorted((r.query_id, r.path, r.hook, r.shared) for r in search.hook_matches(hooks, asked).collect())
    assert got == [(1, "a", "how is a pump repaired", 2), (1, "b", "pump", 1), (2, "a", "how is a pump repaired", 0), (2, "b", "pump", 0)]
    assert {k for t in ("alike", "met", "pairs") for k in kinds[t].values()} == {"bigint"}
