"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

from markbook.plans import catalog, views
from tools import compare

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, small, name):
    problem = compare.compare(spark, duck, small, name, QUERIES[name], SQL.get(name))
    assert problem in (None, "no rows") if name in MAY_BE_EMPTY else problem is None


# on two hundred short documents nothing may be left of these
MAY_BE_EMPTY = {"overlap_report", "dropped_samples"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "question_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_parts_follow_their_size(spark, small, monkeypatch):
    # one file, many parts: a fixed number of parts would grow with the table
    docs = views.table(spark, small, "documents")
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    monkeypatch.setattr(views, "PART_BYTES", -(-int(size) // 40), raising=False)
    assert views.documents(spark, small).rdd.getNumPartitions() in (39, 40)
