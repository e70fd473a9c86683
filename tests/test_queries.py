"""Every registered query against its SQL, and its result under another partitioning."""

import pytest
from brassledger.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from conftest import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", [FLAGSHIP, "receipt_links", "savings_advice"])
def test_partition_count_does_not_matter(spark, sf_dir, name):
    many = rows_of(QUERIES[name](spark, sf_dir).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows_of(QUERIES[name](spark, sf_dir).toPandas()) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["statement_files_parsed", "file_reports"])
def test_a_header_stands_in_its_rows_file(spark, sf_dir, duck, name):
    """Adaptive execution may put the partitions of rows and of headers together in different ways."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = QUERIES[name](spark, sf_dir).toPandas()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert rows_of(got) == rows_of(duck.sql(ORACLE_SQL[name]).df())


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert entry.llm is None and FLAGSHIP in entry.queries() and "op9_mixing" not in entry.oracle_sql()
    monkeypatch.undo()
    importlib.reload(entry)
