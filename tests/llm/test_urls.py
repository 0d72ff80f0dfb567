import re

import pyarrow as pa
import pytest

from mendset.llm import urls
from mendset.llm.queries import QUERIES, URL_RULES


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = None
    for action, rule in URL_RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            best = max(best or ("", ""), (rule, action), key=lambda r: len(r[0]))
    return best or (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "http://a.NET", "http://net/", "x://example.net?/en/", "http://example.com/de/?q",
       "http://É.org/fr/1#t", "http://notexample.com/de/", "a://b://c.net/x", "http://x.example.net/EN/", "http://org/fr", "http://u\n.net/x\ny"]


def test_rules_on_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(ODD)], "page_id int, url string, host string")
    rows = {r.page_id: r for r in urls.judged(pages, URL_RULES).collect()}
    for i, u in enumerate(ODD):
        host, path = plain_host_path(u)
        rule, action = plain_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (action or "allow")  # nothing is labelled as rejected here
    assert urls.judged(pages.filter("false"), URL_RULES).count() == 0


def test_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op3_url_filter"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = plain_host_path(pages[r.page_id])
        rule, action = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        spam = bool(set(re.split("[.-]", host)) & set(urls.REJECTED_TERMS))
        assert r.verdict == (action or ("block" if spam else "allow"))


def test_whole_urls_are_judged(spark):
    good = [f"http://www.{w}.example.org/en/{i}?page={w}" for i, w in enumerate(["garden", "letters", "museum", "weather", "physics"] * 40)]
    bad = [f"http://{a}-{b}.example.org/en/{i}?u={b}-{a}" for i, (a, b) in enumerate([("casino", "win"), ("win", "bets"), ("free", "casino"), ("bets", "now")] * 40)]
    odd = ["http://www.garden.example.org/out?page=museum", "http://www.garden.example.org/out?u=casino-win-bets-casino-free-casino",
           "www.museum.example.org/en/7?page=garden", "free-bets-casino.example.org/en/7?u=bets-casino"]
    pages = spark.createDataFrame(list(enumerate([*odd, *good, *bad, None])), "page_id int, url string")
    p = {r.page_id: r.p_block for r in urls.judged(pages, []).collect()}
    assert p[0] < p[1] and p[2] < 0.5 < p[3] and p[len(odd) + len(good) + len(bad)] is not None


def test_held_out_hosts():
    good = [f"www.{w}.example.org/en/{i}.html" for i, w in enumerate(["garden", "letters", "museum", "weather", "physics"] * 40)]
    bad = [f"{a}-{b}.example.org/en/{i}" for i, (a, b) in enumerate([("casino", "win"), ("win", "bets"), ("free", "casino"), ("bets", "now")] * 40)]
    model = urls.Ratio(good, bad)
    fresh = model.blocked(pa.array(["www.gardening.example.org/en/7.html", "free-bets.example.org/en/7", "casino-now.example.org/en/9"]))
    assert fresh[0] < 0.5 < min(fresh[1:])


def test_probabilities_sum_to_one():
    model = urls.Markov(pa.array(["abab", "abc", ""]))
    texts = pa.array([f"ab{chr(c)}" for c in range(128)])
    codes, n = urls._codes(texts)
    ends = n.cumsum() - n
    third = [c[ends + 2] for c in codes]
    assert 0.4 < (10 ** model.log10(third)).sum() <= 1.0 + 1e-9


def test_logistic_separates():
    import numpy as np

    slope, bias = urls.logistic(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert slope > 0 and abs(bias / slope) < 0.5
    assert urls.logistic(np.zeros(4), np.array([0.0, 0.0, 0.0, 1.0]))[1] == pytest.approx(np.log(1 / 3), abs=0.02)
