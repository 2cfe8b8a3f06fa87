"""Every registered storefront query against its SQL twin, on the smallest tables."""

import numbers
import os

import pandas as pd
import pytest

from storeloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or pd.isna(v):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if isinstance(v, numbers.Number):
        return int(v) if float(v).is_integer() else round(float(v), 9)
    return v


def rows(frame, columns):
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(name, spark, duck):
    ours = registry.queries()[name](spark, DATA).toPandas()
    sql = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(sql.columns)
    assert sorted(ours.columns) == columns
    assert rows(ours, columns) == rows(sql, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_html_context_reads_the_page(spark, tmp_path):
    image = '<img src="https://a.test/1.jpg?a=1&b=2">'
    pages = [(1, "u", f'<div class="use_main_st_bg mobile">{image}</div>' + "x" * 400), (2, "u", "<p>none</p>"), (3, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.reason for r in registry.queries()["f11_html_context"](spark, str(tmp_path)).collect()}
    assert got == {1: "duplicate", 2: "decorative_asset", 3: "decorative_asset"}


@pytest.mark.parametrize("name", ["f11_html_context", "p05_cyberbiz", "p02_observe"])
def test_null_html_equals_sql(name, spark, duck, tmp_path):
    """DuckDB's concat takes a null part as an empty one; so do the inputs derived in Spark."""
    pages = [(1, "https://a.test/1", f'<div class="use_main_st_bg mobile">{"x" * 400}</div>'), (2, "https://a.test/2", "<p>none</p>"), (3, "https://a.test/3", None), (5, "https://a.test/5", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    ours = registry.queries()[name](spark, str(tmp_path)).toPandas()
    with duck.cursor() as con:
        con.execute(f"create temp view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        sql = con.execute(registry.oracle_sql()[name]).df()
    assert rows(ours, sorted(sql.columns)) == rows(sql, sorted(sql.columns))


def equals_sql(name, spark, duck, folder, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    ours = registry.queries()[name](spark, str(folder)).toPandas()
    with duck.cursor() as con:
        con.execute(f"create temp view pages as select * from '{folder}/pages.parquet/*.parquet'")
        sql = con.execute(registry.oracle_sql()[name]).df()
    return rows(ours, sorted(sql.columns)) == rows(sql, sorted(sql.columns))


def test_catalogue_search_keeps_pages_of_one_url(spark, duck, tmp_path):
    urls = ["https://a.test/en/1?utm_source=x", "https://a.test/en/1?utm_source=x", "https://a.test/en/2?utm", "https://a.test/fr/none", "https://a.test/fr/none", "https://a.test/fr/12", None]
    assert equals_sql("f15_catalogue_search", spark, duck, tmp_path, [(i, u, "") for i, u in enumerate(urls)])
    got = registry.queries()["f15_catalogue_search"](spark, str(tmp_path)).collect()
    assert sorted(r.summary for r in got) == sorted([urls[0], urls[1], urls[2], urls[5]])


@pytest.mark.parametrize("end", ["\n", "\r", "\u0085", "\u2028"])
def test_catalogue_search_reads_line_ends_as_sql(spark, duck, tmp_path, end):
    urls = [f"https://a.test/en/1?a{end}b", f"https://a.test/en/1{end}", f"https://a.test/en/1?a{end}", f"https://a.test/en/1{end}/2"]
    assert equals_sql("f15_catalogue_search", spark, duck, tmp_path, [(i, u, "") for i, u in enumerate(urls)])


def test_extract_asks_for_each_page_of_one_url(spark, duck, tmp_path):
    """Each length modulo 6 (the client's kinds of answers), each URL on four pages of one task, in a row and apart."""
    urls = ["https://a.test/" + "é" * n for n in range(6)] + ['https://a.test/"\\\n1']
    pages = [(i, u, "") for i, u in enumerate([u for u in urls for _ in range(2)] + urls * 2)]
    assert equals_sql("p06_extract", spark, duck, tmp_path, pages)
    got = registry.queries()["p06_extract"](spark, str(tmp_path)).collect()
    assert {(len(pages[r.id][1]) % 6, r.attempts) for r in got} == {(0, 1), (1, 2), (2, 1), (3, 3), (4, 3), (5, 3)}
