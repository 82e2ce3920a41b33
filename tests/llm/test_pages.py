"""Operators over web pages."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tocsin.llm import page_text, url_reputation

PAGES = "page_id bigint, url string, html string"


def collected(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def test_marked_pages(spark):
    rows = [
        (1, "http://a.net/x", "<html><head><title>no</title><style>p{}</style><script>var t='</p><p>no';</script></head><body><nav>Menu<li>x</nav>"
            "<div class=\"ad\">Buy</div><article><h1>Head&amp;line</h1><p>One <b>bo</b>ld\n\n line<br>two&nbsp;x<p>a &lt;b&gt; &#233;<aside>side</aside>"
            "<form><input>f</form><div id='comments'><article>reader</article></div></article><footer>&copy; x</footer>"),
        (2, "http://a.net/y", None),
        (3, None, ""),
        (4, "nothing", "<article>cut &am"),
        (5, "http://a.net/z", "<main><p>text<a href='x>y'>link</a></p><!-- no <p>no --><table><tr><td>c1<td>c2</table></main>tail"),
        (5, "http://a.net/z", "<article>twice</article"),
        (7, None, "<div class='wrap has-sidebar'><header>top</header><article><div class='entry-header'>T</div>x<div class=share-bar>s</div></article>"),
        (6, "http://a.net/l", "<article><p>" + "long words " * 60_000 + "</article>"),
    ]
    df = spark.createDataFrame(rows, PAGES)
    out = page_text.main_text(df.withColumn("host", F.lit(1)).withColumn("part", F.lit(2)).withColumn("text", F.lit(3)))
    found = collected(out, "page_id", "text")
    assert found == sorted(
        [
            (1, "Head&line One bold line two\u00a0x a <b> é"),
            (2, ""),
            (3, ""),
            (4, "cut &am"),
            (5, "textlink c1 c2"),
            (5, "twice"),
            (7, "T x"),
            (6, ("long words " * 60_000).strip()),
        ],
        key=repr,
    )
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert page_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("part, kept", [
    ('<h2 id="related-work">Head</h2>', "Head"), ('<section id="discussion"><p>Whole</p><p>text</p></section>', "Whole text"),
    ('<section class="discussion">Points</section>', "Points"), ('<p class="notice">Please note</p>', "Please note"),
    ('<div class="social-history">Of the town</div>', "Of the town"), ('<h3 class="comment">On method</h3>', "On method"),
    ('<div class="related">Earlier <i>work</i> shows more than <a href=x>this</a></div>', "Earlier work shows more than this"),
    ('<div class="related"><a href=x>Story one</a> <a href=y>Story two</a></div>', ""),
    ('<ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul>', ""),
    ('<div class="newsletter">Read us weekly<form><input></form></div>', ""),
    ('<div class="newsletter">Read us weekly <button>Go</button></div>', ""),
    ('<div class="share-bar">Tell others</div>', ""), ('<div class="cookie-notice">We bake</div>', ""),
    ('<div class="ad">Buy</div>', ""), ('<p class="sponsored">Buy</p>', ""), ('<aside>Side</aside>', ""),
    ('<div class="comments"><p>I liked it</p></div>', ""), ('<div id="comments"><div>I liked it</div></div>', ""),
    ('<section id="comments-on-method">Ours</section>', "Ours"), ('<div class="notice">Open to the end', "Open to the end"),
])
def test_articles_keep_their_own_text(part, kept):
    """Inside an article a class takes a second sign, and an id of a heading, section or paragraph takes nothing."""
    for before, after in (("<p>One</p>", "<p>Two</p>"), ("", "")):
        article, _, found = page_text.blocks_of(f"<body><article>{before}{part}{after}")
        expected = " ".join(filter(None, ["One" * bool(before), kept, "Two" * bool(after)]))
        assert found and " ".join(article) == expected


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    frame = "Welcome to our little site about many things please read the following with care"
    end = "All of this was written by hand in the year of the dragon and belongs to nobody"
    rows = []
    for host in ("a.org", "b.org"):
        for k in range(12):
            own = " ".join(f"{host[0]}{k}w{i}" for i in range(30))
            rows.append((len(rows), f"https://{host}/{k}", f"<div>{frame}</div><div>{own}</div><p>start{k} {end}</p>"))
    lone = f"<div>{frame} of mine</div>"
    rows.append((100, "https://c.org/", lone))
    found = dict(collected(page_text.main_text(spark.createDataFrame(rows, PAGES)), "page_id", "text"))
    for k, (page_id, url, _) in enumerate(rows[:-1]):
        host = url[8]
        assert found[page_id] == " ".join(f"{host}{k % 12}w{i}" for i in range(30)) + f" start{k % 12}"
    assert found[100] == f"{frame} of mine"  # one page repeats nothing


def test_frames_of_large_hosts_and_short_blocks(spark):
    """What stands on three pages of a host goes, on a host of many groups too, over block borders and in short blocks."""
    notice = "This notice stands on few pages of a large host and has more than eight words in it"
    menu = "<ul><li>Home</li><li>All our news</li><li>Who we are</li><li>Write to us</li></ul>"
    rows, own = [], {}
    for host, n, every in (("large.org", 1000, 250), ("small.org", 40, 10)):
        for k in range(n):
            page_id = len(rows)
            mine = [f"{host[0]}{k}w{i}" for i in range(25)]
            first = "" if k % every else f"<p>{notice}</p>"
            cell = "<table><tr><td>7</td></tr></table>"  # stands on every page, but amid the page's own text
            tail = f"<p>{mine[0]}{k}</p><p>(c) Us</p>"
            rows.append((page_id, f"http://{host}/{k}", f"{menu}<p>{' '.join(mine[:12])}</p>{cell}{first}<p>{' '.join(mine[12:])}</p>{tail}"))
            own[page_id] = " ".join([*mine[:12], "7", *mine[12:], f"{mine[0]}{k}"])
    rows += [(5000 + k, "http://two.org/", f"<p>{notice}</p><p>only{k}</p>") for k in range(2)]
    own |= {5000 + k: f"{notice} only{k}" for k in range(2)}
    found = dict(collected(page_text.main_text(spark.createDataFrame(rows, PAGES)), "page_id", "text"))
    # With the notice after it, the cell begins a run of more than eight words that stands on these few pages.
    for page_id, text in found.items():
        assert text in (own[page_id], own[page_id].replace(" 7 ", " ")), page_id
    assert sum(" 7 " in text for text in found.values()) == 1032 and len(found) == len(rows)


def test_repeated_runs_by_brute_force():
    import random

    import numpy as np

    rng = random.Random(4)
    shared = [rng.choice("abcdefgh") for _ in range(25)]
    words, page = [], []
    for k in range(9):
        mine = [rng.choice("abcdefgh") for _ in range(30)]
        mine += shared[rng.randrange(5) : 25 - rng.randrange(5)] if k % 2 else []
        words += [*mine, ""]
        page += [k] * len(mine) + [-1]
    got = page_text._repeated(words, np.array(page), 3)
    n, seen = len(words), {}
    inside = lambda i: i + 8 <= n and len(set(page[i : i + 8])) == 1 and page[i] >= 0
    for i in range(n):
        if inside(i):
            seen.setdefault(tuple(words[i : i + 8]), set()).add(page[i])
    expected = np.zeros(n, dtype=bool)
    for i in range(n):
        if inside(i) and len(seen[tuple(words[i : i + 8])]) >= 3:
            expected[i : i + 8] = True
    assert expected.any() and (got == expected).all()


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1?x=/en/", "https://EXAMPLE.com/de/#a", "http://b.example.com/de", "http://x.org/fr/1",
    "http://org/fr/", "http://anet/en/", "http://notexample.com/de/1", "http://net", "http://net?/", "", None, "no scheme", "x://y://z/w", "://h/p",
    "http://É.net/", "http://a.example.net\n/en/2", "http://c.com/1", "http://c.com/2", "http://c.com/3", "http://c.com/4", "http://c.com/5",
    "http://c.com/6", "http://d.c.com/1", "http://e.com/1", "http://" + "a" * 5000 + ".com/" + "b" * 50_000,
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(17, 24)] + [(24, 0), (3, None)], "page_id bigint, bad int")
    rows = url_reputation.judge(pages.withColumn("host", F.lit("x")).withColumn("rate", F.lit(1)).withColumn("n", F.lit(1)), outcomes).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = plain_parts(URLS[r["page_id"]])
        fits = [(rule, v) for rule, v in url_reputation.RULES for of, _, rest in [rule.partition("/")]
                if (host == of or host.endswith("." + of)) and path.startswith("/" + rest)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["lower"] > url_reputation.LIMIT else "allow"))
        assert 0 < r["rate"] < 1 and r["lower"] < r["rate"]
    by_host = {r["host"]: r for r in rows}
    assert by_host["c.com"]["verdict"] == "block" and by_host["e.com"]["rate"] < by_host["c.com"]["rate"]
    assert url_reputation.judge(pages.limit(0), outcomes).count() == 0
    assert {r["rate"] for r in url_reputation.judge(pages, outcomes.limit(0)).collect()} == {0.5}


def test_posterior(spark):
    """Counts, moments and posterior of a small tree against a plain computation."""
    hosts = [("a.x.com", 10.0, 9.0), ("b.x.com", 20.0, 3.0), ("c.y.com", 4.0, 0.0), ("d.z.org", 8.0, 4.0), ("e.z.org", 0.0, 0.0), ("f.new", 0.0, 0.0)]

    def weight(units):
        n, bad, k = sum(u[0] for u in units), sum(u[1] for u in units), len(units)
        m = bad / n
        scatter, spread = sum(b * b / c for c, b in units) - bad * m, m * (1 - m)
        room = n - sum(c * c for c, _ in units) / n - (k - 1)
        rho = (scatter / spread - (k - 1)) / room if spread > 0 and room > 0 else None
        return min(1000.0, max(2.0, 1 / rho - 1)) if rho is not None and rho > 0 else 1000.0

    known = [h for h in hosts if h[1]]
    domain = {}
    for h, n, b in known:
        domain.setdefault(".".join(h.split(".")[-2:]), []).append((n, b))
    suffix = {}
    for d, units in domain.items():
        suffix.setdefault(d.split(".")[-1], []).append((sum(u[0] for u in units), sum(u[1] for u in units)))
    tops = [(sum(u[0] for u in units), sum(u[1] for u in units)) for units in suffix.values()]
    top = ((sum(u[1] for u in tops) + 0.5) / (sum(u[0] for u in tops) + 1), weight(tops))
    post = lambda parent, units: (parent[0] * parent[1] + sum(u[1] for u in units)) / (parent[1] + sum(u[0] for u in units))
    at_suffix = {s: (post(top, units), weight(units)) for s, units in suffix.items()}
    at_domain = {d: (post(at_suffix[d.split(".")[-1]], units), weight(units)) for d, units in domain.items()}
    found = {r["host"]: r for r in url_reputation.reputation(spark.createDataFrame(hosts, "host string, n double, bad double")).collect()}
    for h, n, b in hosts:
        d = ".".join(h.split(".")[-2:])
        mean, w = at_domain.get(d) or at_suffix.get(d.split(".")[-1]) or top
        alpha, beta = mean * w + b, (1 - mean) * w + n - b
        rate = alpha / (alpha + beta)
        assert found[h]["rate"] == pytest.approx(rate)
        assert found[h]["lower"] == pytest.approx(rate - 1.645 * math.sqrt(rate * (1 - rate) / (alpha + beta + 1)))


def test_registered_domains(spark):
    """Suffixes of two labels, ports, user parts and addresses."""
    expected = {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"),
        "www.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "me.github.io:8080": ("me.github.io", "github.io"), "user:pw@x.org:80": ("x.org", "org"), "x.org:": ("x.org", "org"),
        "10.0.0.1:81": ("10.0.0.1", "[]"), "10.0.0.2": ("10.0.0.2", "[]"), "[::1]:80": ("[::1]", "[]"), "": ("", ""),
        "1.2.3.4.5": ("4.5", "5"),
    }
    df = spark.createDataFrame([(h,) for h in expected], "host string")
    rows = df.select("host", url_reputation.domain_of(F.col("host")), url_reputation.suffix_of(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == expected
