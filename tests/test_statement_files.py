"""How statement files are read: what their number costs, and dates as each format alone reads them."""

from brassledger.functions import dates
from brassledger.operators import classify, dims
from brassledger.sources import statements
from brassledger.store import many_files
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layouts_are_no_python_group_a_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("Date,Description,Amount\n13/01/2024,Café,-1.50\n")
    lines = statements.scan(spark, str(tmp_path))
    found = statements.layouts(lines, spark)
    assert "FlatMapGroupsInPandas" not in plan_of(found)
    assert [(r.txn_date, r.descriptions, r.amount, r.header_line) for r in found.collect()] == [(0, [1], 2, 0)] * 3


def test_rows_are_not_broadcast_to_their_narrations(spark):
    rows = spark.range(50).select(F.concat(F.lit("shop "), F.col("id") % 2).alias("description_raw"), F.lit(-100).alias("amount_cents"), "id")
    plan = plan_of(classify.classify(rows, dims.rules(spark)))
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_many_files_take_few_listing_tasks(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with many_files(spark):
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before


def test_a_format_is_left_out_only_where_it_reads_nothing(spark):
    texts = [
        "2024-01-05", "2024/01/05", "20240105", "+20240105", "-20240105", "05-01-2024", "05/01/2024", "05.01.2024", "5/1/2024", "05-01-24", "05/01/24", "05.01.24", "13/31/2024",
        "01/31/2024", "01-31-2024", "1/31/2024", "01/31/24", "5 Jan 2024", "5 January 2024", "Jan 5 2024", "January 5 2024", "5-Jan-2024", "5-January-2024", "5-Jan-24", "5 Jan 24",
        "Jan 5, 2024", "January 5, 2024", "2024-01-05T10:11:12", "2024-01-05 10:11:12", "2024/01/05 10:11", "05/01/2024 10:11", "05/01/2024 10:11:12", "12024-01-05", "5/01/2024", "x/y/zzzz", "123456", "----------",
    ]
    formats = sorted({*dates.SHARED, *dates.DAY_FIRST, *dates.MONTH_FIRST, *dates.NAMED, *dates.TIMED})
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    lost = t.select("t", F.explode(F.array(*(F.when(F.try_to_timestamp("t", F.lit(f)).isNotNull() & ~dates._looks(F.col("t"), f), F.lit(f)) for f in formats))).alias("f"))
    assert lost.where("f IS NOT NULL").collect() == []
