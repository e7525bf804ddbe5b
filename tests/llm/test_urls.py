import numpy as np

from millrace.llm import urls
from millrace.llm.queries import URL_RULES

PAGES = [(1, "https://A.Example.NET/en/x?q#f"), (2, "http://example.net"), (3, None), (4, "no scheme"), (5, "http://example.com/de/1"), (6, "http://myexample.com/de/1"), (7, "ftp://x.org/fr/"), (8, "http://org/fr/x"), (9, "http://example.net/de/"), (9, "http://example.net/de/"), (10, "a://b://c"), (11, "http://x.net?u"), (12, "http://net/"), (13, "http://.net/"), (14, "://x.net/"), (15, "http://x.ORG/fr"), (None, "http://Éx.net/é"), (16, "http://a.net/" + "long/" * 20_000), (17, "")]


def plain(url, rules):
    host, path = urls.split(url)
    fits = [(len(r), r, v) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_judge(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "'x' as host", "1 as key")
    for limit in (urls.FILTER_BYTES, 0):
        got = urls.judge(pages, urls.rules_table(spark, [(r, v) for v, r in URL_RULES]), filter_bytes=limit).collect()
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((str(i), *(str(x) if k == 2 else x for k, x in enumerate(plain(u, URL_RULES)))) for i, u in PAGES)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in urls.judge(pages, urls.canonical(none)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), urls.canonical(none)).collect() == []


def test_split_cases():
    assert urls.split("x://A.b/C?d/e") == ("a.b", "/C") and urls.split("x://h#f/") == ("h", "") and urls.split("x://") == ("", "")


def test_filter_has_no_false_negatives_and_few_false_positives():
    keys = [f"host{i}.example/path" for i in range(5000)]
    table = np.zeros((512, urls.LANES), np.uint32)
    block, mask = urls.lanes(urls.hashes(keys), len(table))
    np.bitwise_or.at(table, block, mask)
    assert urls.might_hold(table, keys).all()
    assert urls.might_hold(table, [f"other{i}" for i in range(20_000)]).mean() < 0.02


def test_many_rules(spark):
    rules = [(f"h{i}.com/p{i % 3}/", "block" if i % 2 else "allow") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i % 3}/z") for i in range(0, 6000, 7)], "page_id long, url string")
    for limit in (urls.FILTER_BYTES, 2048):  # at once, and in four ranges of blocks
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, urls.rules_table(spark, rules), filter_bytes=limit).collect()}
        assert got == {i: (rules[i] if i < 3000 else (None, "allow")) for i in range(0, 6000, 7)}
