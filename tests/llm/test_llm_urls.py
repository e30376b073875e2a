"""URL filters: parsing, longest rule, propagation over redirects and canonical links."""

from riskweave.llm import urls

SCHEMA = "page_id long, url string, html string, rule string, verdict string"


def judge(spark, rows, rules=urls.RULES):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = urls.judge(pages.select("page_id", "url"), urls.redirect_edges(pages), rules)
    return {r["page_id"]: r.asDict() for r in out.collect()}


def test_hosts_paths_and_longest_rule(spark):
    rows = [(1, "HTTP://A.Example.COM/en/x?q#f"), (2, "http://www.example.com/en/"), (3, "https://x.net/es/1"), (4, "https://net/fr/"),
            (5, "https://xnet.org/fr/"), (6, "http://example.com"), (7, "no scheme/en/"), (8, None), (9, ""), (10, "http://ÄB.net/fr/é?x=://y"),
            (11, "http://a.www.example.com/en/z"), (12, "http://example.com?x=/en/"), (13, "a://b://c/d"), (14, "http://x.net\n/es/")]
    got = judge(spark, [(i, u, None) for i, u in rows])
    want = {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            3: ("x.net", "/es/1", "net/es/", "block"), 4: ("net", "/fr/", "net/fr/", "block"), 5: ("xnet.org", "/fr/", None, "allow"),
            6: ("example.com", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
            10: ("Äb.net", "/fr/é", "net/fr/", "block"), 11: ("a.www.example.com", "/en/z", "www.example.com/en/", "allow"),
            12: ("example.com", "", None, "allow"), 13: ("b:", "//c/d", None, "allow"), 14: ("x.net\n", "/es/", None, "allow")}
    assert {i: tuple(r[k] for k in ("host", "path", "rule", "verdict")) for i, r in got.items()} == want


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    link = '<HTML><link rel="canonical" href="{}">'
    jump = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [(1, "http://a.org/1", link.format("http://x.net/es/1")), (2, "https://b.org/2?x=1&y=2", jump.format("http://a.org/1#top")),
            (3, "http://www.example.com/en/ok", link.format("//x.net/es/1")), (4, "http://c.org/d/e", link.format("../other")),
            (5, "http://c.org/free", "<p>canonical</p>"), (6, "http://a.org/6", link.format("/1")), (7, "http://A.ORG/1", None),
            (8, "http://d.org/8", link.format("https://b.org/2?x=1&amp;y=2")), (9, "http://e.org/9", link.format("https://b.org/2")),
            (2, "https://b.org/2?x=1&y=2", None), (10, None, link.format("http://x.net/es/1"))]
    got = judge(spark, rows)
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block",
                                                        8: "block", 9: "allow", 10: "allow"}
    assert {i: r["via"] for i, r in got.items() if i in (1, 3, 5)} == {1: "alias", 3: "rule", 5: "default"}


def test_long_redirect_chain_and_star(spark):
    page = '<link href="http://h.org/{}" rel=canonical>'
    rows = [(i, f"http://h.org/{i}", page.format(i + 1)) for i in range(60)] + [(60, "http://h.org/60", page.format("bad/"))]
    rows += [(100 + i, f"http://s.org/{i}", page.format(30)) for i in range(40)]
    got = judge(spark, rows, [("block", "h.org", "/bad/")])
    assert len(got) == 101 and {r["verdict"] for r in got.values()} == {"block"}


def test_no_pages(spark):
    assert judge(spark, []) == {}


def test_random_graphs_against_union_find(spark):
    import random
    for seed in range(3):
        rng = random.Random(seed)
        hosts = ["a.org", "b.net", "www.example.com", "example.com", "c.com"]
        paths = ["/", "/es/", "/fr/", "/en/"]
        nodes = [rng.choice(hosts) + rng.choice(paths) + str(i) for i in range(120)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)] + [(nodes[0], None)]
        parent = {n: n for n in nodes}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if b is not None:
                parent[top(a)] = top(b)

        def own(n):
            host, path = n.split("/", 1)
            fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
            return max(fits)[1] if fits else None

        linked = {n for e in edges if e[1] is not None and e[0] != e[1] for n in e}
        blocked = {top(n) for n in linked if own(n) == "block"}
        want = {n: own(n) or ("block" if n in linked and top(n) in blocked else "allow") for n in nodes}
        pages = spark.createDataFrame([(i, "http://" + n) for i, n in enumerate(nodes)], "page_id long, url string")
        got = urls.judge(pages, spark.createDataFrame(edges, "a string, b string")).collect()
        assert {nodes[r["page_id"]]: r["verdict"] for r in got} == want
        assert {r["via"] for r in got} == {"rule", "alias", "default"}


def test_megabyte_pages_are_read_in_linear_time(spark):
    import time
    pages = ["<link rel=x " * 90_000, "<meta " + "http-equiv = " * 90_000, "<" * 1_000_000, "<link " + " " * 1_000_000,
             "<p>" * 300_000 + '<link rel="canonical" href="/b">', "<link rel='canonical' href=" + "x" * 1_000_000 + ">"]
    df = spark.createDataFrame([(i, f"http://h.org/{i}" + "y" * (i == 0) * 500_000, h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    began = time.time()
    edges = urls.redirect_edges(df).collect()
    assert {(e["a"], len(e["b"])) for e in edges} == {("h.org/4", len("h.org/b")), ("h.org/5", len("h.org/") + 1_000_000)}
    assert time.time() - began < 30
