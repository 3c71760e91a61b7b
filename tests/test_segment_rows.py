from quillspark.operators import chunks


def test_segments_take_no_frame_for_each_text(spark):
    text = "\n\n".join(["word " * 100] * 6)
    rows = spark.createDataFrame([(f"c{i}", text) for i in range(300)] + [("empty", ""), ("null", None)], "chunk_id string, segment string")
    found = chunks.segments(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    sums = {r.chunk_id: r[1] for r in found.groupBy("chunk_id").sum("len").collect()}
    assert set(sums) == {f"c{i}" for i in range(300)} and set(sums.values()) == {len(text)}
