"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import connect, differences
from pageflow.plans.catalog import QUERIES
from pageflow.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, root, con, name):
    frame = entry.queries()[name](spark, root)
    assert differences(frame, con, entry.oracle_sql()[name]) == []


def test_entry_returns_contexts(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "n_results", "context"]
    rows = frame.collect()
    assert rows and all(r.n_results <= 3 and r.context.endswith("...") for r in rows)


@pytest.fixture(scope="module")
def shared_urls(root, tmp_path_factory):
    """The smallest tables, in which several pages have one URL, some of them one title, too."""
    folder = tmp_path_factory.mktemp("shared-urls")
    for table in Path(root).glob("*.parquet"):
        if table.stem != "pages":
            (folder / table.name).symlink_to(table)
    pages = f"read_parquet('{root}/pages.parquet')"
    duckdb.sql(f"""COPY (SELECT p.page_id, q.url, CASE WHEN p.page_id % 6 = 1 THEN q.html ELSE p.html END AS html
        FROM {pages} p JOIN {pages} q ON q.page_id = p.page_id - p.page_id % 3) TO '{folder}/pages.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["stored_pages", "retrieve_results", "record_messages", "respond_requests"])
def test_pages_of_one_url_are_told_apart(spark, shared_urls, name):
    frame = entry.queries()[name](spark, shared_urls)
    assert differences(frame, connect(shared_urls), entry.oracle_sql()[name]) == []
