"""What the plans must not do, whatever the data."""

import re

import pytest
from pyspark.sql import functions as F

from pageflow import schemas, settings as S
from pageflow.functions import text as native
from pageflow.operators import content, latency, search
from pageflow.plans.catalog import QUERIES
from pageflow.sources import tables

BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
NARROW = [n for n in BATCH if n.startswith(("response_", "stage_", "parse", "validate", "topk", "paginate", "search_"))]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_no_cross_joins(spark, root, name):
    plan = plan_of(QUERIES[name](spark, root))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def many_files(spark, root, tmp_path_factory):
    """The page table as enough files for every core."""
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    spark.read.parquet(f"{root}/pages.parquet").repartition(16).write.option("maxRecordsPerFile", 4).parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    yield tables.spread(spark.read.parquet(path))
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pages_are_not_shuffled(many_files):
    everything = content.with_content(
        content.with_metadata(many_files), S.ContentSettings(output_formats=("text", "markdown", "html"))
    )
    corpus = many_files.select(
        F.col("page_id").alias("doc_id"), F.lit("h").alias("host"), native.layout(F.col("html")).alias("text")
    )
    for frame in (everything, content.blocks_table(many_files, "page_id"), search.build_index(corpus)):
        assert "Exchange" not in plan_of(frame)


def test_few_files_are_spread(spark, root):
    one_file = spark.read.parquet(f"{root}/pages.parquet")
    assert one_file.rdd.getNumPartitions() == 1
    assert tables.spread(one_file).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_only_needed_columns_are_read(spark, root):
    pages = spark.read.schema(schemas.PAGES).parquet(f"{root}/pages.parquet")
    narrow = re.search(r"ReadSchema: struct<(.*?)>", plan_of(pages.select("page_id", "url").filter("page_id > 3")))
    assert narrow[1] == "page_id:bigint,url:string"
    assert "html" in plan_of(content.with_metadata(pages).select("page_id", "title"))


def test_hot_requests_spread_over_runs(spark):
    measures = spark.range(0, 4000).select(
        F.floor(F.col("id") / 10_000).alias("request_id"), F.col("id").alias("seq"), F.lit("e").alias("event"), (F.col("id") * 5).alias("time_us")
    )
    plan = plan_of(latency.with_deltas(measures, 100))
    assert re.search(r"hashpartitioning\(request_id#\d+L?, _run#\d+L", plan)
    assert latency.with_deltas(measures, 100).filter("seq > 0 AND delta_us <> 5").count() == 0


def test_tasks_grow_with_the_table(spark, tmp_path):
    """However few files a table has, no task takes more than its share of rows; small splits stay where they are."""
    rows = 12 * tables.TASK_ROWS
    spark.range(rows).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(rows).repartition(16).write.parquet(str(tmp_path / "many.parquet"))
    one = tables.spread(tables.read_table(spark, str(tmp_path), "one"))
    sizes = [len(part) for part in one.rdd.glom().collect()]
    assert sum(sizes) == rows and len(sizes) == 12 and max(sizes) <= 1.1 * tables.TASK_ROWS
