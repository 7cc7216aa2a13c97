"""What the votes of a host decide, against a plain reading of them, and pages of great depth."""

import random
import time
import tracemalloc
from collections import defaultdict

import pytest

from pairwright.llm import html_main

SCHEMA = "page_id long, url string, html string"
WORDS = "river stone light over under many small green house road while winter walks".split()


def prose(seed, n=250):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def page(i, name, wrap="article"):
    """An article and six stray parts around it; ``name`` gives their classes."""
    return (f"<body><div class={name('topbar')}>Welcome to the site, reader</div>"
            f"<div class={name('gdpr-bar')}>We keep {i} small files on your machine.</div>"
            f"<div class={name('lead')}>{prose(f'intro {i}', 12)}</div>"
            f"<{wrap} class=post><h1>Title {i}</h1><p>{prose(i)}</p></{wrap}>"
            f"<section class={name('discussion')}><p>Reader Bob says {prose(f'bob {i}', 15)}</section>"
            f"<ol class={name('thread')}><li>{prose(f'first {i}', 9)}<li>{prose(f'second {i}', 9)}</ol>"
            f"<div class={name('gift')}>Give us money if you like this site.</div>"
            f"<div class={name('bottom')}>&copy; {2000 + i} the site</div></body>")


def article(i):
    return f"{prose(f'intro {i}', 12)}\n\nTitle {i}\n\n{prose(i)}"


@pytest.mark.parametrize("name", [lambda n: n, lambda n: "k" + "abcdefghijklmnop"[len(n)] + n[0]], ids=["names", "no names"])
def test_stray_parts_are_left_out_by_votes(spark, name):
    rows = [(i, f"https://site.example/{i}", page(i, name)) for i in range(6)]
    got = texts(spark, rows)
    assert got == {i: article(i) for i in range(6)}


def test_votes_decide_and_not_the_page_alone(spark):
    """The same page, alone on its host or a copy of the only other one, keeps what the host's votes would leave out."""
    name = lambda n: "k" + n[0]
    alone = texts(spark, [(0, "https://a.example/0", page(0, name)), (1, "https://a.example/1", page(0, name))])
    assert alone[0] == alone[1] and alone[0].startswith("Welcome to the site, reader\n\nWe keep 0 small")
    assert "Bob" not in alone[0] and "©" not in alone[0]      # what follows an article is not in it


def test_sections_that_differ_are_kept(spark):
    def body(i):
        return (f"<body><nav><a href=/>Menu</a></nav><div class=post><h1>Title {i}</h1><div class=intro>{prose(f'in {i}', 9)}</div>"
                f"<div class=entry><p>{prose(i)}</p></div><div class=more>{prose(f'more {i}', 20)}</div>"
                f"<div class=box>Read our other pages too.</div></div></body>")
    got = texts(spark, [(i, f"https://b.example/{i}", body(i)) for i in range(4)])
    assert got == {i: f"Title {i}\n\n{prose(f'in {i}', 9)}\n\n{prose(i)}\n\n{prose(f'more {i}', 20)}" for i in range(4)}


def test_consensus_against_a_plain_count(spark):
    r = random.Random(5)
    rows = [(i, f"https://h{r.randrange(4)}.example/{i}",
             page(i % 25, lambda n: r.choice(["u", "v", "w7"]) + n[0], r.choice(["article", "article", "div", "main"])))
            for i in range(80)]
    rows += [(100, None, None), (101, "https://h0.example/x", ""), (102, None, "<p>" + prose(1))]
    won, sides, mains = defaultdict(lambda: defaultdict(float)), defaultdict(list), defaultdict(set)
    for _, url, html in rows:
        host = url.split("/")[2] if url else ""
        v = html_main.Page(html or "").votes()
        if v:
            won[host][v["path"]] += v["weight"]
            for s in v["sides"]:
                sides[host].append((s["part"], s["said"], s["share"]))
                mains[host, s["part"], s["said"]].add(v["main"])
    want = {}
    for host, paths in won.items():
        total = sum(paths.values())
        kept = sorted((-round(w, 6), p) for p, w in paths.items() if w >= html_main.WIN_SHARE * total)
        again = set()
        for part in {s[0] for s in sides[host]}:
            own = [s for s in sides[host] if s[0] == part]
            twice = [s for s in own if len(mains[host, part, s[1]]) > 1]
            if (len(twice) >= html_main.REPEAT_SHARE * len(own)
                    and sum(s[2] for s in own) >= html_main.SIDE_SHARE * sum(s[2] for s in sides[host])):
                again.add(part)
        want[host] = ([p for _, p in kept], again)
    got = html_main.consensus(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.host: (x.paths, set(x.repeated or ())) for x in got} == want
    assert any(again for _, again in want.values())
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, html_main.main_text(frame).collect())) \
        == sorted(map(str, html_main.main_text(frame, broadcast_hosts=0).collect()))


@pytest.mark.parametrize("html", ["<div class=a>" * 100_000 + "x", "<div>x" * 100_000, "<b>" * 100_000 + "<h1>x</h1>" * 20_000,
                                  "<div>" * 50_000 + "x</span>" * 100_000, "<a '" * 100_001 + "<p>x", "<p><b>x" * 50_000],
                         ids=["nested", "unclosed", "inline", "stray", "quotes", "paragraphs"])
def test_depth_costs_no_more_than_length(html):
    begun = time.time()
    p = html_main.Page(html)
    p.votes()
    p.text([])
    assert time.time() - begun < 8          # two seconds on a quiet machine; minutes if the depth counted squared
    del p
    tracemalloc.start()
    html_main.Page(html[:len(html) // 4]).votes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
