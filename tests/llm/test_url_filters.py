from ledgerwright.llm import url_filters as u


def judged(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, rule string")
    return {r["page_id"]: r for r in u.judge(df, u.page_links(df)).collect()}


def test_hosts_paths_and_longest_rule(spark):
    pages = [
        (1, "http://A.Example.COM/fr/x?y#z", None, "mine"),
        (2, "https://example.com/en/a", "", None),
        (3, "https://www.example.com/en/a", "", None),
        (4, "https://x.net/es/", "", None),
        (5, "https://x.net", "", None),
        (6, "notanet/es/", "", None),
        (7, None, None, None),
        (8, "https://badexample.com/en/", "", None),
        (9, "HTTP://host?x://y/es/", "", None),
        (10, "a://É.NET/fr/b#c", "", None),
    ]
    got = judged(spark, pages)
    want = {
        1: ("a.example.com", "/fr/x", "com/", "allow"),
        2: ("example.com", "/en/a", "example.com/en/", "block"),
        3: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        4: ("x.net", "/es/", "net/es/", "block"),
        5: ("x.net", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("badexample.com", "/en/", "com/", "allow"),
        9: ("host", "", None, "allow"),
        10: ("É.net", "/fr/b", "net/fr/", "block"),
    }
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want


def test_blocks_reach_aliases_unless_one_is_allowed(spark):
    canonical = "<LINK href='{0}' rel=canonical>"
    refresh = '<meta http-equiv="refresh" content="0; url={0}">'
    pages = [
        (1, "https://a.org/1", canonical.format("https://x.net/es/1"), None),
        (2, "https://b.org/2", refresh.format("https://a.org/1"), None),
        (3, "http://m.a.org/1.html", "", None),
        (4, "https://c.org/3", canonical.format("https://x.net/fr/3"), None),
        (5, "https://d.com/3", canonical.format("https://c.org/3"), None),
        (6, "https://e.org/9", canonical.format("/10"), None),
        (7, "https://e.org/10", canonical.format("https://x.net/es/7"), None),
        (8, "https://f.org/1", canonical.format(""), None),
    ]
    got = judged(spark, pages)
    assert {k: r["verdict"] for k, r in got.items()} == {
        1: "block",  # its canonical address is blocked
        2: "block",  # two steps away
        3: "block",  # a variant of the first
        4: "allow",  # blocked alias, but another one is allowed by a rule
        5: "allow",
        6: "block",  # over an address from the root
        7: "block",
        8: "allow",
    }
    assert all(r["rule"] is None for k, r in got.items() if k != 5)


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    rows = spark.createDataFrame([(1, "https://x.net/es/", None)] * 3, "page_id long, url string, html string")
    assert u.judge(rows, u.page_links(rows)).count() == 3
