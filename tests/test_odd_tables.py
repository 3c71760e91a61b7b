"""Queries against their SQL on small tables made for a case that the given ones do not hold."""

import duckdb
import pytest

from quillspark.plans import catalog, checks  # noqa: F401

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def same(spark, tmp_path):
    """A check that a query gives what its SQL gives on some tables."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, frame in tables.items():
            frame.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        frame = catalog.queries()[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in frame.columns)
        key = lambda row: tuple((v is None, str(v)) for v in row)
        got = sorted(map(tuple, frame.collect()), key=key)
        assert got == sorted(con.sql(f"select {columns} from ({catalog.oracle_sql()[name]})").fetchall(), key=key)
        return got

    return check


def docs(spark, *rows):
    return spark.createDataFrame([(i, text, "en", "src1", len(text)) for i, text in rows], DOCS)


def test_longer_numbers_stand_first(spark, same):
    got = same("verbatim_numbers", documents=docs(spark, (6720, "a. b"), (5, "a"), (7, "b"), (8, "c")))
    assert (6720, "7720 77", "", True, False) in got


def test_evidence_of_a_sentence_of_one_character(spark, same):
    got = same("extraction_rules", documents=docs(spark, *[(i, "K. and more") for i in (21, 42, 63, 105, 7)], (14, "a longer one. x")))
    assert ("u21", "evidence_dup", "warning") in got and ("u21", "evidence_trimmed", "error") not in got
