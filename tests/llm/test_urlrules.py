import time

from lociframe.llm import urlrules

URLS = {
    1: ("HTTP://A.Example.COM/en/7/x?y#z", "a.example.com", "/en/7/x", "example.com/en/7", "allow"),
    2: ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
    3: ("http://com/en/", "com", "/en/", "com/en/", "block"),
    4: ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    5: ("http://www.example.net/de/81", "www.example.net", "/de/81", "example.net/de/8", "block"),
    6: ("http://other.net/de/81", "other.net", "/de/81", "net/de/", "allow"),
    7: ("a://b.org?q=/es/", "b.org", "", None, "allow"),
    8: ("a://b.org/es/#x", "b.org", "/es/", "org/es/", "block"),
    9: (None, "", "", None, "allow"), 10: ("no scheme/en/", "", "", None, "allow"), 11: ("", "", "", None, "allow"), 12: ("://", "", "", None, "allow"),
    13: ("http://É.com/EN/", "É.com", "/EN/", None, "allow"), 14: ("x://h:80/p/" + "q" * 100_000, "h:80", "/p/" + "q" * 100_000, None, "allow"),
}


def pages(spark):
    return spark.createDataFrame([(i, u[0], "t", "t") for i, u in URLS.items()] + [(1, URLS[1][0], "t", "t")], "page_id long, url string, terms string, host string")


def test_listed_rules(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = urlrules.judge(pages(spark), urlrules.mine(pages(spark), none, **urlrules.MINING)).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], r
    empty = pages(spark).limit(0)
    assert urlrules.judge(empty, urlrules.mine(empty, none, **urlrules.MINING)).count() == 0


def test_mined_rules(spark):
    """Bad pages are those with both tokens; neither alone is a rule, though one is on more than half of the pages."""
    data = [(i, f"http://{'win' if i % 2 else 'news'}.site{i % 7}.org/{'bonus' if i % 3 == 0 else 'read'}/{i}") for i in range(1200)]
    docs = spark.createDataFrame(data, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (i % 2 and i % 3 == 0)), 0 if i % 5 else None) for i in range(600)] + [(3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    mined = urlrules.mine(docs, labels, **urlrules.MINING)
    rules = {tuple(r.terms): (r.confidence, r.term) for r in mined.rules.collect()}
    assert rules[("h:win", "p:bonus")][0] == 1.0 and ("h:win",) not in rules and ("p:bonus",) not in rules
    assert not any(len(t) > 2 and {"h:win", "p:bonus"} < set(t) for t in rules)
    for r in urlrules.judge(docs, mined, ()).collect():
        assert (r.verdict == "block") == ("win" in r.host and "bonus" in r.path)
        assert (r.mined_confidence or 0) >= (0.6 if r.verdict == "block" else 0)


def test_thirty_shared_tokens(spark):
    """Tokens of the same pages are one class, so pages of one site don't give 2**30 sets; any of them stands for it."""
    shared = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    data = [(i, f"http://site.net/{shared}/x{'' if i % 2 else '/spam'}") for i in range(200)] + [(i, f"http://fine.org/{'spam' if i % 2 else 'ham'}/y") for i in range(200, 600)]
    data += [(900, "http://else.com/partab/spam"), (901, "http://else.com/partab/ham"), (902, "http://else.com/parta/spam")]
    docs = spark.createDataFrame(data, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (i < 200 and i % 2 == 0)), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    start = time.time()
    mined = urlrules.mine(docs, labels, **urlrules.MINING)
    assert [(r.terms, r.confidence, r.pages) for r in mined.rules.collect()] == [(["h:net", "p:spam"], 1.0, 100)]
    got = {r.page_id: r.verdict for r in urlrules.judge(docs, mined, ()).collect()}
    assert time.time() - start < 30
    assert {i for i, v in got.items() if v == "block"} == {*range(0, 200, 2), 900}


def test_long_rule(spark):
    """Only five tokens together are bad; every four of them are mostly on good pages."""
    names = ["aa", "bb", "cc", "dd", "ee"]
    data = [(i, "http://x.org/" + "/".join(names)) for i in range(10)]
    data += [(100 + 20 * k + j, "http://x.org/" + "/".join(n for n in names if n != names[k])) for k in range(5) for j in range(20)]
    docs = spark.createDataFrame(data, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 100), None if i % 2 else 0) for i, _ in data] + [(i, int(i >= 100), 0) for i, _ in data], "doc_id long, quality int, toxic int")
    mined = urlrules.mine(docs, labels, **urlrules.MINING)
    assert [r.terms for r in mined.rules.collect()] == [[f"p:{n}" for n in names]]


def test_few_bad_pages_in_a_large_table(spark):
    """Five bad pages of a host make a rule, however many other pages are labelled."""
    docs = spark.range(6000).selectExpr("id AS page_id", "concat('http://', if(id < 5, 'evil', concat('h', id % 50, chr(97 + id % 20))), '.org/', chr(97 + id % 26), '/a') AS url")
    labels = spark.range(6000).selectExpr("id AS doc_id", "int(id >= 5) AS quality", "0 AS toxic")
    got = urlrules.judge(docs, urlrules.mine(docs, labels, **urlrules.MINING), ())
    assert [r.page_id for r in got.where("verdict = 'block'").orderBy("page_id").collect()] == [0, 1, 2, 3, 4]
