"""The classifier learns from all labelled rows, and workers give back memos."""

import numpy as np
from pyspark.sql import functions as F
from test_llm import labelled

from quillspark.llm import arrow, byte_bpe, toxicity


def test_all_labelled_rows_are_counted_and_learned_from(spark, monkeypatch):
    docs, labels = labelled(spark)
    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    seen = {}
    calibrate = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda *x: seen.update(n=x[5].sum(), ones=x[5][x[2] == 1].sum()) or calibrate(*x))
    learn = toxicity.learn_all
    monkeypatch.setattr(toxicity, "learn_all", lambda coded, members, *x: seen.update(before=[m.vector() for m in members]) or learn(coded, members, *x))
    model = toxicity.train(docs, labels)
    whole = labels.where(~toxicity.held_out(F.col("doc_id")))
    assert seen["n"] == whole.count() and seen["ones"] == whole.where("toxic = 1").count()
    assert all(not np.array_equal(a, m.vector()) for a, m in zip(seen["before"], model.members, strict=True))
    started = toxicity.Classifier([toxicity.TextCnn.of_vector(v) for v in seen["before"]])

    def right(m):
        rows = toxicity.score(docs, m).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
        ones, zeros = ([r.score for r in rows if r.toxic == c] for c in (1, 0))
        return np.mean([a > b for a in ones for b in zeros])

    assert right(model) > max(0.9, right(started))


def test_a_class_of_long_texts_only(spark, monkeypatch):
    docs, labels = labelled(spark, 300)
    monkeypatch.setattr(toxicity, "DOC_WORDS", 1)
    assert toxicity.train(docs, labels).constant is None


def test_parts_of_documents():
    part = toxicity.parts_of(np.array([7, -1, *range(1000)]), {7: 3}, 4)
    assert part[0] == part[2 + 7] == 3 and set(part.tolist()) == {0, 1, 2, 3}


def test_memos_end_with_their_stage():
    coder = byte_bpe.encoder(byte_bpe.default_vocabulary())
    coder.encode(["some words of a text"])
    arrow.release(memos=False)
    assert byte_bpe.encoder(byte_bpe.default_vocabulary()) is coder
    arrow.release()
    assert byte_bpe.encoder(byte_bpe.default_vocabulary()) is not coder


def test_the_limit_is_of_both_memos():
    coder = byte_bpe.Encoder(byte_bpe.default_vocabulary(), limit=400)
    for start in range(0, 900, 300):
        coder.encode([f"h{i} s{i}" for i in range(start, start + 300)])
        assert len(coder.spaced) + len(coder.plain) <= 400 + 2 * 300


def test_labelled_rows_are_coded_by_one_python_function_in_a_task(spark):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    some = toxicity.known(labels)
    coded = toxicity.code(docs, some)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan  # two in a task are two workers for it, and both stay
    ids = [r.doc_id for r in some.collect()]
    assert sorted(r.doc_id for r in coded.collect()) == sorted(r.doc_id for r in docs.where(F.col("doc_id").isin(ids)).collect()) != []
