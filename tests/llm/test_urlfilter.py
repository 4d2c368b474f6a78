import re
from collections import Counter

from inkwell.llm import urlfilter as U


def page(i, url, *hosts):
    return (i, url, "<p>" + "".join(f'<a class="x" HREF="https://{h}/p">t</a>' for h in hosts) + '<a href="/own">o</a>')


ROWS = [
    page(1, "http://A.Example.COM/en/7817?x=1", "spam-farm.org"),
    page(2, "https://b.example.com/en/1"),
    page(3, "https://example.com/en/7"),
    page(4, "https://notexample.com/en/7#f"),
    page(5, "http://x.example.net/de/84"),
    page(6, "http://x.example.net/de/48", "friend.org", "x.example.net"),
    page(7, "http://friend.org/fr/1", "far.org"),
    page(8, "http://far.org?es/1"),
    page(9, "http://org/es/"),
    (10, "http://linker.org/fr/", '<a href="http://spam-farm.org/es/1"></a><a href="http://spam-farm.org/es/2"></a>'),
    page(11, "http://spam-farm.org/fr/2"),
    (12, None, None),
    (12, "no scheme/en/", ""),
    (13, "http://alone.net/fr/://x", None),
    (None, "http://net/de/", "<a href=//FRIEND.org/x>"),
]


def brute(rows=ROWS):
    def split(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        own = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(own, key=lambda r: len(r.text), default=None)

    judged = [split(url) for _, url, _ in rows]
    edges, seed = {}, {"allow": Counter(), "block": Counter()}
    names = {h for h, _, _ in judged}
    for h, _, f in judged:
        if f:
            seed[f.verdict][h] += 1
    for (h, _, _), (_, _, html) in zip(judged, rows, strict=True):
        for address in re.findall(U.LINK, html or ""):
            t, _, f = split("http:" + address if address.startswith("//") else address)
            if h and t and t != h:
                edges[h, t] = edges.get((h, t), 0) + 1
                names.add(t)
                if f:
                    seed[f.verdict][t] += 1
    start = {v: {h: n[h] / max(1, n.total()) for h in names} for v, n in seed.items()}
    now, turn = dict(start), bool(edges)
    while turn:
        new = {}
        for verdict, at in (("allow", 0), ("block", 1)):
            total = Counter()
            for e, n in edges.items():
                total[e[at]] += n
            lost = sum(x for h, x in now[verdict].items() if not total[h])
            new[verdict] = {h: (0.15 + 0.85 * lost) * start[verdict][h] for h in names}
            for e, n in edges.items():
                new[verdict][e[1 - at]] += 0.85 * now[verdict][e[at]] * n / total[e[at]]
        turn = sum(abs(new[v][h] - now[v][h]) for v in new for h in names) >= U.TOLERANCE
        now = new
    out = []
    for (i, _, _), (h, p, f) in zip(rows, judged, strict=True):
        t, d = now["allow"][h], now["block"][h]
        own = "block" if d > 0.5 * (t + d) else "allow"
        out.append((i, h, p, f and f.text, f.verdict if f else own, round(t, 9), round(d, 9)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = sorted(((*r[:5], round(r.trust, 9), round(r.distrust, 9)) for r in U.filter_urls(df.repartition(4)).collect()), key=str)
    assert got == brute()
    by = {r[0]: r for r in got}
    assert by[1][3] == "example.com/en/7" and by[4][3] == "com/en/" and by[5][4] == "block" and by[10][4] == "block" and by[7][4] == "allow"


def test_blocked_hosts_without_pages_are_seeds_and_scores_are_shares(spark):
    rows = [(1, "http://links.fr/a/", '<a href="http://far.org/es/x">'), (2, "http://before.fr/a/", '<a href="//links.fr/">'), (3, "http://clean.fr/a/", '<a href="//other.fr/">'), (4, "http://net/de/", None)]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), tolerance=0.02).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert got[4].trust == 1 and got[1].distrust > got[2].distrust > 0 == got[3].distrust
    # far.org is the only seed: what it gives is damped once a link, and what ends at before.fr comes back to it
    assert abs(got[1].distrust / got[2].distrust - 1 / 0.85) < 0.1


def test_no_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(*ROWS[0], "z")], "page_id long, url string, html string, host string")
    assert U.filter_urls(df.selectExpr("*", "1 AS pages", "2 AS fit", "3 AS rule", "4 AS n"), tolerance=0.5).first().rule == "example.com/en/7"
    long = spark.createDataFrame([(1, "http://org/es/" + "x" * 200_000, "<p>" * 200_000), (1, "http://org/es/", None)], "page_id long, url string, html string")
    assert [r.verdict for r in U.filter_urls(long, tolerance=0.5).collect()] == ["block", "block"]
    assert U.filter_urls(df, tolerance=0.5).count() == 1
    assert U.filter_urls(df.limit(0)).count() == 0
