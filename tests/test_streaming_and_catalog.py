"""The stream of notes, and every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.operators import buckets
from quillspark.plans import catalog
from quillspark.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_note_stream_merges_by_path(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    note = "---\ntitle: {}\nflow: f\n---\nbody"
    (inbox / "a.md").write_text(note.format("A"))
    (inbox / "b.md").write_text(note.format("B"))

    def run():
        ingest.merge_into(ingest.note_stream(spark, f"file://{inbox}"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    run()
    (inbox / "c.md").write_text(note.format("C"))
    run()
    (inbox / "d.md").write_text(note.format("D"))
    run()
    assert sorted(r.title for r in buckets.read(spark, f"{tmp_path}/out").collect()) == ["A", "B", "C", "D"]


def test_windowed_counts_match_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert ingest.windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    order = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=order)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tables.sql(f"select {quoted} from ({catalog.oracle_sql()[name]})").fetchall(), key=order)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
