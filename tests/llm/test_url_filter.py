import re

from gazeloom.llm import url_filter as U

URLS = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q#f", "http://example.org/en/2", "http://example.org", "http://example.org?x=/es/", "http://xexample.org/es/",
        "http://b.com/fr/", "http://com/de/1", "http://b.com/de", "http://b.com/DE/", "http://É.com/de/é", None, "", "no scheme.org/", "a://", "a://?://org/", "http://x.org#/y",
        "http://u@org:80/", "http://.org/", "http://org./", "http://a..com/fr/#", "http://b.com/fr/\n/de/", "x://y://example.org/es/", "http://" + "s." * 500 + "example.org/es/" + "p" * 5000]


def brute(url, rules=U.RULES):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_against_brute_force(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, URLS[1], None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((tuple(r) for r in U.judge(df, U.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, _ in rows), key=str)


def test_other_rules(spark):
    rules = [("b.a", "/x", "block"), ("a", "/x/yy", "allow"), ("a", "", "block"), (None, "/", "block"), ("c", None, "block"), ("A", "", "allow")]
    urls = ["http://c.b.a/x/yy", "http://b.a/x", "http://a", "http://c/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {0: ("a/x/yy", "allow"), 1: ("b.a/x", "block"), 2: ("a", "block"), 3: (None, "allow")}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge(df, none).where("rule IS NULL AND verdict = 'allow'").count() == 4
    assert U.judge(df.where("false"), U.rule_table(spark)).count() == 0
