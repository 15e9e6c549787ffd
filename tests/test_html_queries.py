"""HTML queries against their SQL on pages whose entities are cut off."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tunekit.functions import html as H
from tunekit_checks.compare import rows_of
from tunekit_checks.oracle import oracle_sql
from tunekit_checks.queries import REGISTRY

SF = "/root/testdata/sf0.001"
PAGES = [
    (1, "u1", "<html><head><title>a &amp; b&amp</title></head><body><h1>c&amp</h1><p>&copy; d &quot;e&quot;</p></body></html>"),
    (2, "u2", "<html><head><title>&ampx; &&amp;&</title></head><body><p>f&quot</p>&middot;<p>&amp;copy;</p></body></html>"),
]
QUERIES = ["html_metadata", "html_sections", "html_text_regex", "html_text_tree", "parse_documents"]


@pytest.mark.parametrize("name", QUERIES)
def test_cut_entities(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(5).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df, result = REGISTRY[name](spark, str(tmp_path)), con.execute(oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_terminated_entities(spark):
    texts = ["a &amp b", "&lt;p&gt;", "&copy &#169; &#xA9;", "&notit; &nope; &#169", "&amp;amp;", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    found = [r[0] for r in df.select(H.unescape(F.col("t"), terminated=True)).collect()]
    assert found == ["a &amp b", "<p>", "&copy © ©", "&notit; &nope; &#169", "&amp;", None]
