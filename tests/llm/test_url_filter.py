from urllib.parse import urlsplit

from venuescope.llm import url_filter
from venuescope.llm.queries import QUERIES

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query_against_brute_force(spark, sf, rows_of):
    got = {r.page_id: r for r in QUERIES["op10_url_filter"](spark, sf.replace("0.001", "0.01")).collect()}
    pages = rows_of(sf.replace("0.001", "0.01"), "pages", "page_id", "url")
    assert len(got) == len(pages)
    for i, url in pages:
        parts = urlsplit(url)
        rule, verdict = rule_of(parts.netloc.lower(), parts.path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (parts.netloc.lower(), parts.path, rule)
        junk = any(x in r.host for x in ("casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x"))
        assert r.verdict == (verdict or ("block" if junk else "allow"))


def test_odd_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.COM/EN/?q"), (5, "x://com/en/"), (5, "x://com/en/"), (6, "a://b://c/d#e?f"), (None, "https://example.com/en/7/x"), (7, "https://sub.example.net"), (8, "https://xcom/en/"), (9, "h://é" + "z" * 5000)]
    pages = spark.createDataFrame([(i, u, "r", "s") for i, u in urls], "page_id long, url string, rule string, score string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert (rows[1].host, rows[1].path, rows[1].verdict) == ("", "", "allow") and rows[3].host == ""
    assert (rows[4].host, rows[4].path, rows[4].rule) == ("a.example.com", "/EN/", None)
    assert (rows[5].rule, rows[5].verdict) == ("com/en/", "block")
    assert (rows[6].host, rows[6].path) == ("b:", "//c/d")
    assert (rows[None].rule, rows[None].verdict) == ("example.com/en/7", "allow")
    assert rows[8].rule is None and rows[9].verdict == "allow" and rows[7].path == ""
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def judged_rows(spark, sf, seeds):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return [r for r in url_filter.filter_urls(pages, seeds=seeds).collect() if r.rule is None]


def test_junk_whose_term_is_no_seed(spark, sf):
    """Each kind of junk in turn without its seed: what the model has learned of the others must tell."""
    rows = {seed: judged_rows(spark, sf.replace("0.001", "0.1"), tuple(s for s in url_filter.SEEDS if s != seed)) for seed in ("ads", "casino", "spam")}
    caught = {seed: [r.verdict == "block" for r in own if seed in r.host.replace("-", ".").split(".")] for seed, own in rows.items()}
    clean = [r.verdict for own in rows.values() for r in own if not any(x in r.host for x in ("casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x"))]
    assert clean.count("block") == 0
    # Of the casino's pages none is found without its seed (README), of the two other kinds all are.
    assert {seed: (len(c), sum(c)) for seed, c in caught.items()} == {"ads": (9, 9), "casino": (8, 0), "spam": (7, 7)}


def test_no_clean_host_is_blocked(spark, sf):
    rows = judged_rows(spark, sf.replace("0.001", "0.1"), url_filter.SEEDS)
    junk = {r.page_id for r in rows if any(x in r.host for x in ("casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x"))}
    assert len(rows) > 1700 and len(junk) > 50 and {r.page_id for r in rows if r.verdict == "block"} == junk


def test_labels_as_input(spark):
    urls = [(i, f"https://site{i}.example.com/fr/{'qzx' * 4 if i % 3 == 0 else 'news'}", None if i % 7 == 0 else i % 3 == 0) for i in range(120)]
    pages = spark.createDataFrame(urls, "page_id long, url string, junk boolean")
    rows = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rejected_col="junk").collect()}
    assert rows == {i: "block" if i % 3 == 0 else "allow" for i, _, _ in urls}


def test_models_block_unseen_junk(spark):
    good = [(i, f"https://www.travel{i}.example.org/fr/{i}") for i in range(60)]
    junk = [(100 + i, f"https://casino-win{'' if i else ''}.example.com/fr/{i}") for i in range(30)]
    pages = spark.createDataFrame(good + junk + [(999, "https://xcasinowin.example.com/fr/3")], "page_id long, url string")
    rows = {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert all(rows[i] == "allow" for i, _ in good) and all(rows[i] == "block" for i, _ in junk) and rows[999] == "block"


def test_models_count_every_url(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(url_filter, "train", lambda counts, real=url_filter.train: seen.append(real(counts)) or seen[-1])
    urls = [(i, f"https://casino.example.com/fr/{i}") for i in range(100, 900)] + [(i, f"https://www.travel{i}.example.org/fr/") for i in range(10)]
    rows = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    # All 800 pages have one shape: its strings are not seen once.
    assert {"casi", "asin", "sino"} <= {r.gram for r in seen[0].collect()}
    assert rows[100].verdict == "block" and rows[0].verdict == "allow"
