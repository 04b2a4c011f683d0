"""Queries over keyed fixtures take all rows."""

import duckdb
import pytest

from sievelight.queries import catalog
from sievelight.queries import fixtures as X

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", ["decision_card", "decision_id", "decision_totals", "name_header"])
def test_all_rows(spark, name):
    sql = catalog.SQL[name]
    assert "% 5 = 0)" not in sql
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    assert plain(got.collect()) == plain(con.execute(sql).fetchall())


def test_every_order_line_is_a_detection(spark):
    assert X.found(spark, DATA).count() == X.table(spark, DATA, "lineitem").count()


def test_every_order_line_is_a_word_and_a_result(spark):
    n = X.table(spark, DATA, "lineitem").count()
    assert X.ocr_words(spark, DATA).select("doc_id", "span_id").distinct().count() == n
    assert X.ocr_results(spark, DATA).select("doc_id", "backend_order").distinct().count() == n


#: Numbers side by side: a blank must part the digits around it, and a number that goes is gone inside a longer one as well.
CROWDED = [
    "5555555555554444\té : 4111-1111-1111-1111, 2  S  7  7  6  b  l  4  3  8  5  O  1  2  S  1  0  5  4  9  6",
    "4O12 8888 8888 1881 \n3530 1113 3330 00005555555555554444 5555555555554444 ",
    "4111-1111-1111-1111 : O/3/z/9/0/7/4/7/7/5/7/3\t4222222222222, 378282246310005\t4222 2222 2222 2 4222222222222-",
    "Z1-3 5 9 B z 2\t6011 1111 1111 1117 4222 2222 2222 2 6011 1111 1111 1117 : ",
    "\t : 9 4 3 : 6011 1111 1111 11176011 1111 1111 1117 : and more words for the text to be long enough",
    "4242 4242 4242 4242 * 4111-1111-1111-1111 and O 4O12 8888 8888 1881",
]


@pytest.mark.parametrize("name", ["post_redaction_check", "decision_pci"])
def test_crowded_numbers(spark, tmp_path, name):
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(CROWDED)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("documents", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert plain(catalog.QUERIES[name](spark, str(tmp_path)).collect()) == plain(con.execute(catalog.SQL[name]).fetchall())
