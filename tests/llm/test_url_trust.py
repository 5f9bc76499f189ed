import re

from tilespark.llm import url_trust
from tilespark.llm.queries import op3_url_trust

RULES = url_trust.RULES


def brute(url):
    host = path = ""
    at = (url or "").find("://")
    if at >= 0:
        m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3:], re.S)
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    fits = [(len(r), r, v) for v, r in RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_query_against_brute_force(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = op3_url_trust(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def page(i, url, *links):
    return i, url, "".join(f'<p><A class=x HREF = "{x}">l</a>' for x in links), "q", "w"


def test_trust_and_distrust(spark):
    pages = [page(1, "http://good.com/a", "https://friend.org/x", "/in", "//mixed.org"), page(2, "http://bad.example.com/en/1", "http://victim.org/"),
             page(3, "http://spam.org/1", "http://bad.example.com/en/1", "http://BAD.example.com/z", "http://farm.org"), page(4, "http://friend.org/1", "http://good.com"),
             page(5, "http://farm.org/1", "http://spam.org/"), page(6, "http://mixed.org/q", "http://good.com/", "http://good.com/b"), page(7, "http://victim.org/q?://"),
             page(8, None), page(9, "no url"), page(10, ""), page(11, "HTTPS://Sub.Good.COM#frag"), page(12, "x://y://z"), (13, "http://net/es/", None, "q", "w"),
             page(1, "http://good.com/a")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string, verdict string")
    got = url_trust.judge_urls(frame).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    for i, url, *_ in pages:
        host, path, rule, verdict = brute(url)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        if rule:
            assert by[i].verdict == verdict
    assert {i: by[i].verdict for i in (3, 4, 5, 6, 7, 8, 9, 11)} == {3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 11: "allow"}
    assert by[3].distrust > by[5].distrust > 0 and by[4].trust > 0


def rank(edges, seeds, steps, damping=0.85):
    score = dict(seeds)
    out = {}
    for a, b, n in edges:
        out[a] = out.get(a, 0) + n
    for _ in range(steps):
        new = {h: (1 - damping) * s for h, s in seeds.items()}
        for a, b, n in edges:
            new[b] = new.get(b, 0) + damping * score.get(a, 0) * n / out[a]
        score = new
    return score


def test_scores_against_brute_force(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "d", 5), ("d", "a", 1), ("d", "b", 3), ("e", "a", 1)]
    total = {}
    for a, _, n in edges:
        total[a] = total.get(a, 0) + n
    frame = spark.createDataFrame([("trust", a, b, n / total[a]) for a, b, n in edges], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("trust", "a", 0.5), ("trust", "e", 0.5)], "kind string, host string, start double")
    got = {r.host: r.score for r in url_trust.spread(frame, seeds, steps=12).collect()}
    want = rank(edges, {"a": 0.5, "e": 0.5}, 12)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want)


def test_nothing(spark):
    assert url_trust.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string").selectExpr("page_id", "url", "cast(null as string) as html")
    assert url_trust.judge_urls(one, rules=()).head().verdict == "allow"


def test_null_ids_and_pages_long_urls_and_links_at_once(spark):
    long = "http://Long.example.com/en/" + "p" * 200_000 + "?q=" + "x" * 100_000
    many = "".join(f'<a href="http://host{i}.org/{"y" * 300}">l</a>' for i in range(3000))
    rows = [(None, long, many), (1, "http://long.example.com/en/2", None), (None, None, many), (2, "", many), (2, "", many), (3, "http://" + "h" * 70_000 + ".net/es/1", "<a href"),
            (4, "http://host7.org/1", '<a href="http://long.example.com/en/9">x</a>'), (5, "http://host8.org/1", None)]
    got = url_trust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and sorted((r.page_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    want = {(u, *brute(u)) for _, u, _ in rows}
    assert {(r.host, r.path, r.rule) for r in got} == {w[1:4] for w in want}
    assert {r.verdict for r in got if r.rule} <= {"allow", "block"} and by[3][0].verdict == by[1][0].verdict == "block"
    assert by[4][0].verdict == "block" and by[4][0].distrust > 0  # it links to a blocked host
    assert by[5][0].verdict == "allow" and {(r.host, r.verdict) for r in by[2]} == {("", "allow")}
