import random

from pyspark.sql import functions as F

from quillspark.operators import graph, unions


def test_degrees_equal_counted_edges(spark, monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(unions, "CHUNK", 70)
    monkeypatch.setattr(unions, "PART", 40)
    rows = [(f"n{i}", [f"t{draw.randrange(draw.choice([4, 60]))}" for _ in range(draw.randrange(5))]) for i in range(400)] + [("twice", ["t1"]), ("twice", ["t2", None]), ("none", None)]
    notes = spark.createDataFrame(rows, "path string, topics array<string>")
    pairs = [(f"t{draw.randrange(60)}", f"t{draw.randrange(60)}") for _ in range(150)] + [("t1", "t1"), ("t1", "gone"), (None, "t2")]
    relations = spark.createDataFrame(pairs, "subject string, object string")
    want = graph.concept_edges(relations, notes).groupBy("src").agg(F.count("*").alias("n"))
    assert sorted(unions.concept_degrees(relations, notes).collect()) == sorted(want.collect())


def test_a_topic_of_all_notes_draws_no_edges(spark):
    # 20,000 notes that all lead to each other are 400 million edges.
    notes = spark.range(20_000).select(F.format_string("n%d", "id").alias("path"), F.array(F.lit("a"), F.lit("b"), F.col("id").cast("string")).alias("topics"))
    found = unions.concept_degrees(spark.createDataFrame([("a", "b")], "subject string, object string"), notes)
    assert [tuple(r) for r in found.groupBy("n").count().collect()] == [(19_999, 20_000)]


def test_without_relations_nothing_is_led_to(spark):
    notes = spark.createDataFrame([("x", ["a"])], "path string, topics array<string>")
    assert unions.concept_degrees(notes.selectExpr("path subject", "path object"), notes).isEmpty()
    assert unions.concept_degrees(notes.selectExpr("path subject", "path object"), notes.where("false")).isEmpty()


def test_what_comes_to_cells_does_not_grow_with_the_square_of_the_notes(spark, monkeypatch):
    """Twice the notes, relations and sets give twice the rows that are dealt to cells, not four times as many."""
    monkeypatch.setattr(unions, "CHUNK", 16)
    monkeypatch.setattr(unions, "CELLS", 4, raising=False)

    def dealt(n):
        notes = spark.range(n).select(F.format_string("n%d", "id").alias("path"), F.array(F.format_string("a%d", "id"), F.format_string("b%d", F.col("id") % 9)).alias("topics"))
        relations = spark.range(n).select(F.format_string("a%d", "id").alias("subject"), F.format_string("b%d", F.col("id") % 9).alias("object"))
        seen, counted = spark.sparkContext.accumulator(0), unions._counted

        def met(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return counted(each())

        with monkeypatch.context() as m:
            m.setattr(unions, "_counted", met)
            assert unions.concept_degrees(relations, notes).count() == n
        return seen.value

    assert dealt(800) < 2.2 * dealt(400)
