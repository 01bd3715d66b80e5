"""Operator 10 against its SQL and rules in plain Python."""

import random
import re

import pyarrow as pa
import pytest
from compare import compare, connect

from fluxbook.llm.urls import OP10_SQL, judge_urls, op10_url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
EDGES = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "https://WWW.Example.com/en/1?x=/y", "https://a.example.com/en/", "https://notexample.com/en/1",
    "https://example.com/en", "http://x.net/es/", "http://x.net/es", "http://net/fr/a#/b", "http://x.net?/es/", "http://x.net#a", "a://b://c/d", "http://comx/a", "https://é.com/É",
    "http://x.org//a///b//", "http://x.org/" + "/".join("abcdefgh" * 5), "http://x.org/" + "q" * 50_000,
]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(10)
    out = list(EDGES) + EDGES[4:8]
    for _ in range(600):
        host = rng.choice(["shop.net", "shop.net", "a.shop.net", "x.org", "news.com", "example.com"])
        out.append(f"http://{host}/{rng.choice(['es', 'fr', 'en', 'p', 'cat'])}/{rng.choice(['a', 'b', 'c', str(rng.randrange(99))])}/{rng.choice(['', 'd', 'e'])}")
    return out


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_equals_sql(spark, folder, urls):
    path = folder(pages=pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(["" for _ in urls])}))
    assert compare(op10_url_filter(spark, path), connect(path), OP10_SQL) is None


def test_rules(frame, urls):
    pages = frame([(i, u, 1, 2, 3) for i, u in enumerate(urls)], "page_id long, url string, host int, n int, template int")
    rows = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        host, path = parts(url)
        name, verdict = rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, name)
        assert rows[i]["verdict"] == verdict if verdict else rows[i]["verdict"] in ("allow", "block")


def judged(frame, pages):
    return {r["page_id"]: r for r in judge_urls(frame(list(enumerate(pages)), "page_id long, url string")).collect()}


def test_pages_without_a_rule_go_either_way(frame):
    """One host: branches shaped like the blocked ones go with them, others follow what the rules say about the host; a host
    without labels allows."""
    blocked = [f"http://s.net/{lang}/item{i}" for lang in ("es", "fr") for i in range(40)]
    like_them = [f"http://s.net/it/item{i}" for i in range(40)]
    other = [f"http://t.com/docs/{'x' * (i % 7)}y/part" for i in range(20)] + [f"http://n.org/a/{i}" for i in range(9)]
    mixed = [f"http://example.com/{'en' if i % 2 else 'de'}/{'list' if i % 2 else f'p{i}'}/z" for i in range(60)]
    found = judged(frame, blocked + like_them + other + mixed)
    verdict = lambda rows: {found[i]["verdict"] for i in rows}
    n = len(blocked)
    assert verdict(range(n)) == {"block"} and verdict(range(n, n + 40)) == {"block"}
    assert {found[i]["template"] for i in range(n + 40)} == {"/*/*"} and {found[i]["rule"] for i in range(n, n + 40)} == {None}
    assert verdict(range(n + 40, n + 69)) == {"allow"}
    unruled = [r for r in found.values() if r["rule"] is None]
    assert {r["verdict"] for r in unruled} == {"allow", "block"}
    assert all(r["verdict"] == ("block" if r["purity"] < 0.25 else "allow") for r in unruled)


def test_purity_is_drawn_to_the_parent(frame):
    """A branch of another shape, without labels, has its host's purity; few labels reject nothing."""
    pages = [f"http://s.net/es/{i}" for i in range(30)] + [f"http://s.net/about/{'abcdefg'[i % 7]}" for i in range(30)]
    found = judged(frame, pages)
    assert found[30]["template"].startswith("/about/") and found[30]["purity"] == pytest.approx(1 / 32)
    assert found[0]["purity"] == pytest.approx(1 / 32 / 16 / 16)
    assert {found[i]["verdict"] for i in range(30, 60)} == {"block"}
    few = judged(frame, ["http://s.net/es/a", "http://s.net/about/b", "http://s.net/c"])
    assert few[1]["verdict"] == few[2]["verdict"] == "allow" and few[0]["verdict"] == "block"


def test_deep_paths(frame):
    """Branches that differ only at the tenth segment are told apart; the levels end where no two paths go on together."""
    deep = "/".join("abcdefghi")
    pages = [f"http://x.org/{deep}/{k}/{i}/tail" for k in ("one", "two") for i in range(30)] + ["http://x.org/" + "/".join("q" * 3000)]
    found = judged(frame, pages)
    assert {found[i]["template"] for i in range(60)} == {f"/{deep}/*/*/tail"}
    assert found[60]["template"] == "/" + "/".join("q" * 3000)


def test_repeated_rows_and_empty_table(frame):
    pages = frame([(1, "http://a.net/es/1"), (1, "http://a.net/es/1"), (None, None), (None, None)], "page_id long, url string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in judge_urls(pages).collect()) == [(0, "allow"), (0, "allow"), (1, "block"), (1, "block")]
    assert judge_urls(pages.limit(0)).collect() == []
