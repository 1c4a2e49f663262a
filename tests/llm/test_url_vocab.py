import duckdb
import pandas as pd

from tessella.llm import url_vocab as uv

URLS = [
    "http://a.COM/x", "http://com", "http://com?x", "http://example.com/en/1", "https://WWW.example.com/en/", "http://sub.www.example.com/en/a", "http://badexample.com/en/1", "http://example.com/EN/1",
    "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://y.org/free-spam", "http://y.org/spammer", "http://free.org/cheap?x", "http://free.org/free", "http://y.org/a_free_bet#z", "no scheme", "", None,
    "://", "http://y.org:80/casino.poker", "http://y.org/é-porn", "http://x.net/es/porn", "ftp://a://b.com/c", "http://\nq.org/xxx\n", "http://y.org/" + "a" * 50000 + "-xxx", "http://y.org/xxx", "http://y.org/xxx",
]


def test_rules_and_terms(spark):
    df = spark.createDataFrame([(k, u, "h", None) for k, u in enumerate(URLS)], "page_id long, url string, host string, weight int")
    got = {r.page_id: r for r in uv.filter_urls(df).collect()}
    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})
    con = duckdb.connect()
    con.register("pages", pages)
    for k, host, path, rule, verdict, weight in con.sql(f"SELECT page_id, host, path, rule, verdict, weight FROM ({uv.oracle()})").fetchall():
        assert tuple(got[k])[1:] == (host, path, rule, verdict, weight), URLS[k]
    of = {u: (got[k].rule, got[k].verdict) for k, u in enumerate(URLS)}
    assert of["http://a.COM/x"] == ("com/", "allow") and of["http://com"] == (None, "allow")
    assert of["http://example.com/en/1"] == ("example.com/en/", "block") and of["http://badexample.com/en/1"] == ("com/", "allow")
    assert of["http://sub.www.example.com/en/a"] == ("www.example.com/en/", "allow")
    assert of["http://y.org/free-spam"][1] == "block" and of["http://y.org/spammer"][1] == "allow" and of["http://free.org/free"][1] == "allow" and of["http://free.org/cheap?x"][1] == "block"
    assert of[None] == (None, "allow") and got[len(URLS) - 10].host is not None


def test_empty_table(spark):
    assert uv.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
