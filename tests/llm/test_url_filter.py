from roomrank.llm import url_filter
from roomrank.llm.queries import op3_url_filter
from roomrank.llm.shared import table


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    best = (None, None)
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


URLS = ["http://a.org/x", "https://A.Example.ORG/es/1?q#f", "http://example.org/es/", "http://example.org/en/12", "http://example.org/en/2", "ftp://x.com/fr/9",
        "http://x.com/de/", "http://x.com/de", "http://fr.com", "http://y.com?x=/de/", "http://y.com#/de/", "no scheme", "", None, "://", "http://", "http:///p",
        "http://org/", "http://xorg/", "http://ÄB.org/es/", "http://a.co.uk/en/", "x://y://z/", "http://example.org/en/1?x"]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none).collect()}
    for i, u in enumerate(URLS):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def test_query(spark, sf_small):
    got = {r.page_id: r for r in op3_url_filter(spark, sf_small).collect()}
    pages = table(spark, sf_small, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        host, path = plain(p.url)
        rule, verdict = plain_rule(host, path)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (host, path, rule)
        assert verdict is None or got[p.page_id].verdict == verdict


def test_bad_hosts_are_blocked_and_few_labels_are_not_enough(spark):
    pages, bad = [], []
    for i in range(4000):
        host = f"h{i % 40}.d{i % 8}.net" if i >= 400 else "spam.farm.net"
        pages.append((i, f"http://{host}/p{i}"))
        bad.append((i, int(i < 380 or i % 17 == 0)))
    pages.append((4000, "http://new.net/"))
    bad.append((4000, 1))
    pages.append((4001, "http://other.farm.net/"))  # no labels of its own
    out = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"),
                                                        spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert all(out[i].verdict == "block" for i in range(400))
    assert all(out[i].verdict == "allow" for i in range(400, 4001))
    assert out[4000].host_rate < 0.9 and out[4001].verdict == "block"  # judged by its domain


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_no_python_in_the_plan(spark, sf_small):
    assert "Python" not in op3_url_filter(spark, sf_small)._jdf.queryExecution().executedPlan().toString()


def test_of_fitting_rules_of_equal_length_the_last_given_holds(spark):
    from pyspark.sql import functions as F

    page = spark.createDataFrame([("a.com", "/bcd")], "host string, path string")
    for rules in ([("allow", "a.com/b"), ("block", "com/bcd")], [("block", "com/bcd"), ("allow", "a.com/b")]):
        rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"), rules)
        assert tuple(page.select(rule, verdict).first()) == (rules[-1][1], rules[-1][0])
