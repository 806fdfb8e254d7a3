from fieldlab.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string")


def canonical(to):
    return f'<html><LINK data-x=1 rel="canonical" href="{to}"></html>'


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://A.Example.NET/en/x", None, "clash"),
        (2, "https://example.net/de?x", "", None),
        (3, "https://example.net", None, None),
        (4, "notexample.com/de/", None, None),
        (5, None, None, None),
        (6, "https://q.example.com/de/1#y", canonical("https://alias.info/a"), None),
        (7, "https://alias.info/a?utm=1", None, None),
        (8, "https://third.info/z", '<meta http-equiv="refresh" content="0; url=https://alias.info/a">', None),
        (9, "https://x.org/fr/1", canonical("//mixed.info/m"), None),
        (10, "https://mixed.info/m", canonical("https://b.net/q"), None),
        (11, "https://b.net/q", None, None),
        (12, "https://rel.info/p", canonical("/other"), None),
        (13, "https://rel.info/other", canonical("https://www.example.com/de/r"), None),
        (14, "https://ÀB.Com/É", None, None),
        (15, "", "", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(page(spark, rows + rows[:1]), RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de", "net/", "block")
    assert got[3] == ("example.net", "", None, "allow")
    assert got[4] == got[5] == got[15] == ("", "", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block")
    assert got[7][2:] == got[8][2:] == (None, "block")
    assert got[9][2:] == ("org/fr/", "allow")
    assert got[10][2:] == (None, "allow")  # an allowed alias outranks a blocked one
    assert got[11][2:] == ("net/", "block")  # but not a page's own rule
    assert got[12][2:] == got[13][2:] == (None, "block")  # www.example.com/de/r blocks though it's no page
    assert got[14][:2] == ("Àb.com", "/É")


def test_empty_table_and_given_edges(spark):
    none = page(spark, []).where("page_id > 1")
    assert urls.judge(none, RULES).count() == 0
    edges = spark.createDataFrame([("a.info/", "b.net/"), ("a.info/", None)], "u string, v string")
    rows = [(1, "x://a.info/", None, None), (2, "x://b.net/", None, None)]
    assert [r.verdict for r in urls.judge(page(spark, rows), RULES, edges).orderBy("page_id").collect()] == ["block", "block"]
