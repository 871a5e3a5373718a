from hypothesis import given
from hypothesis import strategies as st

from listwright.llm import url_filter

TERMS = url_filter.automaton(url_filter.STRICT, url_filter.SOFT)


def test_host_and_path():
    cases = {
        None: ("", ""), "": ("", ""), "example.com/a": ("", ""), "http://A.Example.COM": ("a.example.com", ""), "https://a.b/c/D?e#f": ("a.b", "/c/D"),
        "x://h?q/z": ("h", ""), "x://h#/z": ("h", ""), "x:///p": ("", "/p"), "http://h/p#a?b": ("h", "/p"), "http://a/://b": ("a", "/://b"), "http://ÉA/": ("Éa", "/"),
    }
    assert {url: url_filter.split_url(url) for url in cases} == cases


def test_the_longest_fitting_rule_decides():
    fit = lambda host, path: url_filter.fitting(host, path, url_filter.RULES)
    assert fit("a.example.net", "/en/x") == ("example.net/en/", "allow")
    assert fit("a.example.net", "/fr/x") == ("net/", "block")
    assert fit("example.com", "/de/") == ("example.com/de/", "block")
    assert fit("badexample.com", "/de/") is None
    assert fit("org", "/fr/1") == ("org/fr/", "allow")
    assert fit("x.net", "") is None


@given(st.text("abcdefrinostuwxy0-./ ", max_size=40) | st.lists(st.sampled_from(["casino", "free", "bets", "win", "-", "x", ".", "/", "A", "cheap"]), max_size=8).map("".join))
def test_hits_are_terms_between_boundaries(url):
    padded = f" {url.lower()} "
    found = lambda terms: sum(any(padded[i : i + len(t)] == t and not padded[i - 1].isalnum() and not padded[i + len(t)].isalnum() for i in range(1, len(padded) - len(t))) for t in terms)
    assert url_filter.hits(url, TERMS)[:2] == (found(url_filter.STRICT), found(url_filter.SOFT))


def test_tables(spark):
    rows = [(1, "http://casino.example.com/", 0), (2, "http://free.example.com/", 0), (3, "http://free-bets.example.com/", 0), (3, "http://free-bets.example.com/", 0), (None, None, 0), (5, "http://xcasino.example.com/", 0)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host int")).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, "block"), (2, None, "allow"), (3, None, "block"), (3, None, "block"), (None, None, "allow"), (5, None, "allow")], key=repr)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
