import pytest
from pyspark.sql import functions as F

from townkit.llm import hosts


@pytest.fixture(scope="module")
def judged(spark):
    rows = [
        (1, "https://WWW.Example.ORG/es/x?q#f"), (2, "http://example.org/en/1"), (3, "http://example.org/en/23"), (4, "http://notexample.org/es/"), (5, "http://a.example.com/de/x"), (6, "http://com/fr/"),
        (7, "http://x.org"), (8, None), (9, "no scheme/org/"), (10, "http://a.net?u=://b.org/"), (11, ""), (1, "https://WWW.Example.ORG/es/x?q#f"), (None, "http://a.net/"), (12, "http://ÄB.org/Ä"),
    ] + [(100 + i, f"http://bad.net/{i}") for i in range(60)] + [(200 + i, f"http://good{i % 20}.net/{i}") for i in range(400)]
    pages = spark.createDataFrame([(i, u, "h", 1, "x") for i, u in rows], "page_id long, url string, host string, n long, key string")
    labels = [(100 + i, 0, 1) for i in range(60)] + [(200 + i, 1, 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (1, 0, 0)]
    found = hosts.judge_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return found.collect()


def test_rules(judged):
    by = {r["page_id"]: r for r in judged}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert by[2]["rule"] == by[3]["rule"][:16] == "example.org/en/1" or by[3]["rule"] == "org/"
    assert (by[2]["verdict"], by[3]["rule"], by[4]["rule"], by[5]["verdict"], by[6]["rule"]) == ("block", "org/", "org/", "block", "com/fr/")
    assert (by[7]["path"], by[7]["rule"]) == ("", None)
    for k in (8, 9, 11):
        assert (by[k]["host"], by[k]["path"], by[k]["rule"]) == ("", "", None)
    assert (by[10]["host"], by[10]["path"]) == ("a.net", "") and by[12]["host"] == "Äb.org"


def test_every_row_is_judged(judged):
    assert len(judged) == 474 and sum(r["page_id"] == 1 for r in judged) == 2 and sum(r["page_id"] is None for r in judged) == 1


def test_bad_host_is_blocked_and_good_ones_stay(judged):
    assert {r["verdict"] for r in judged if r["host"] == "bad.net"} == {"block"}
    assert {r["verdict"] for r in judged if r["host"].startswith("good")} == {"allow"}


def test_unlabelled_host_takes_the_level_above(judged):
    means = {r["host"]: r["good_mean"] for r in judged}
    assert 0 < means["bad.net"] < means["a.net"] < means["good1.net"] < 1


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert hosts.judge_urls(pages, labels).collect()[0]["verdict"] == "allow"
    assert hosts.judge_urls(pages.limit(0), labels).count() == 0


def test_one_hot_host_and_many_cold(spark, shuffles):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://hot.com/x").otherwise(F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/x"))).alias("url"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("quality"))
    found = hosts.judge_urls(pages, labels)
    assert found.count() == 3000 and found.where("good_mean IS NULL").count() == 0


@pytest.mark.parametrize(("host", "domain", "suffix"), [("a.b.example.com", "example.com", "com"), ("www.shop.co.uk", "shop.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("localhost", "localhost", "localhost"), ("", "", ""), ("u@x.org:80", "x.org", "org")])
def test_domains(spark, host, domain, suffix):
    a, b = hosts.domain_columns(F.lit(host))
    assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).collect()[0]) == (domain, suffix)


def test_both_joins_judge_alike(spark, monkeypatch):
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("pages", "labels"))
    rows = lambda: sorted(map(repr, hosts.judge_urls(pages, labels).collect()))
    small = rows()
    monkeypatch.setattr("townkit.llm.shared.BROADCAST_BYTES", -1)
    assert rows() == small
