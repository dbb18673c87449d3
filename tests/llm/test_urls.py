import re

from tablework.llm import urls

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = []
    for verdict, rule in RULES:
        name, slash, start = rule.partition("/")
        if host and (host == name or host.endswith("." + name)) and path.startswith(slash + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def check(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, host string, suffix string, row long")
    found = urls.filtered(df, urls.rule_table(spark, RULES)).collect()
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in found), key=str)
    want = []
    for name, url, *_ in pages:
        rule, verdict = rule_of(*parts(url))
        want.append((name, *parts(url), rule, verdict))
    assert got == sorted(want, key=str)
    assert {r["verdict"] for r in found} <= {"allow", "block"}
    return found


def odd_urls():
    urls_ = [None, "", "no scheme", "://", "http://", "http:///en/", "http://a.com", "http://A.Com/?q=1&r=2", "x://com/", "x://.com/a"]
    urls_ += ["https://b.Example.com/en/1", "https://www.example.com/en/2#x", "https://w.www.example.com/en/", "https://example.com/EN/"]
    urls_ += ["ftp://x.net/es/", "ftp://net/fr/a?b://c", "http://o.org/" + "a/" * 5000, "http://ä.net/es/é", "http://a.com/\nx", "http://a..com/"]
    return [(i if i % 7 else None, u, "h", "s", 1) for i, u in enumerate(urls_ + urls_[:9])]


def test_odd_urls(spark):
    check(spark, odd_urls())


def test_empty_table_and_no_labels(spark):
    assert check(spark, []) == []
    found = check(spark, [(1, "http://a.org/", "", "", 1), (2, None, "", "", 1)])
    assert {(r["verdict"], r["block_score"]) for r in found} == {("allow", None)}
    found = check(spark, [(1, "http://a.org/", "", "", 1), (2, "http://net/es/", "", "", 1)])
    assert {r["verdict"] for r in found} == {"block"}


def test_trees_learn_what_the_rules_do(spark):
    # Blocked URLs have a query and a long path under both suffixes, .net has no URL that is allowed.
    pages = [(i, f"http://h{i}.net/es/{i}?a=1&b={i}", "", "", 1) for i in range(0, 200, 2)]
    pages += [(i, f"http://h{i}.com/page-{i}", "", "", 1) for i in range(1, 400, 2)]
    pages += [(i, f"http://example.com/en/{i}?a=1&b={i}", "", "", 1) for i in range(200, 400, 2)]
    for i, end in enumerate(("net", "org", "info") * 10):
        pages.append((1000 + i, f"http://h{i}.{end}/xx/{i}?a=1&b={i}", "", "", 1))
        pages.append((2000 + i, f"http://h{i}.{end}/page-{i}", "", "", 1))
    found = check(spark, pages)
    assert all(r["verdict"] == "block" for r in found if 1000 <= r["page_id"] < 2000)
    assert all(r["verdict"] == "allow" for r in found if r["page_id"] >= 2000)


def test_suffix_statistics_leave_the_own_verdict_out(spark):
    pages = [(i, f"http://h{i}.com/{i}", "", "", 1) for i in range(40)] + [(50, "http://example.com/en/", "", "", 1)]
    pages += [(60 + i, f"http://h{i}.net/es/{i}", "", "", 1) for i in range(5)] + [(70, "http://a.net/", "", "", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, suffix string, row long")
    rows = {r["page_id"]: r for r in urls.described(df, urls.rule_table(spark, RULES)).collect()}
    fold = rows[50]["fold"]
    same = sum(r["suffix"] == "com" and r["fold"] == fold for r in rows.values())
    assert abs(rows[50]["f_suffix_blocked"] - 1 / (41 - same + 2)) < 1e-12
    assert {rows[i]["f_suffix_blocked"] for i in (60, 61, 70)} == {-1.0}
    assert {rows[i]["f_suffix_share"] for i in (60, 61, 70)} == {-1.0}
