import pytest

from tessella.llm import html_consensus as hc

LONG = "Some words of a paragraph that go on for quite a while, as those of articles do. " * 3


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>{body}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b &amp; c&#33;", "a\nb & c!"),
        (page(f"<div class='ad'>{LONG}</div><article><h1>Head</h1><p><b>One.<br><p>Two  \n words</p></article>"), "Head\nOne.\nTwo words"),
        (page(f"<div id=content class='post post-12'><p>{LONG}</p><ul><li>x</li></ul><div class=share>Share!</div></div><div class='sidebar'><p>{LONG}{LONG}</p></div><section class=comments><article class=comment><p>{LONG}</p></article></section>"), f"{LONG.strip()}\nx"),
        (page(f"<div><header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{LONG}</p><form><p>Your mail</p><input></form><aside>{LONG}</aside></main></div>"), f"Title\n{LONG.strip()}"),
        (page(f"<form><div><p>{LONG}</p></div></form>"), LONG.strip()),
        (page("<article><p>a</b></i>b</p></div><p>c<!-- x <p>no</p> -->d</p><p hidden>no</p><p style='display:none'>no</p></article>"), "ab\ncd"),
        (page("<article><p title='a>b'>t</p><p>1 < 2 & 3</p><table><tr><td>a<td>b<tr><td>c</table></article>"), "t\n1 < 2 & 3\na b\nc"),
        (page("<article><p>open <em>never closed"), "open never closed"),
    ],
)
def test_extraction(html, want):
    if html and "never closed" in html:
        html = html.split("<footer>")[0]
    assert hc.extract(html, None) == want


def test_the_host_decides(spark):
    story = "<div class='story-{0}'><p>{1}</p></div><div class='rail'><p>{2}</p></div>"
    rows = [(k, f"http://H.com/{k}", page(story.format(k, LONG * 3, LONG))) for k in range(6)]
    # here the rail holds more, but the host's path is the story's
    rows.append((10, "http://h.com/10?x", page(story.format(10, LONG, LONG * 2))))
    rows += [(11, None, page("<article><p>alone</p></article>")), (12, "http://h.com", None), (12, "http://h.com", None), (13, "no url", "")]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, text string")
    for most in (hc.MOST_HOSTS, 0):  # winners broadcast, and joined
        got = hc.extract_pages(df, most_hosts=most).collect()
        text = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and text[10] == LONG.strip() and text[0] == (LONG * 3).strip() and text[11] == "alone" and text[12] == "" == text[13]
        assert all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert hc.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SHORT, LONGER = "The first section says a little. " * 9, "The second section says much more. " * 90


@pytest.mark.parametrize(
    "html,want",
    [
        (page(f"<article><h1>Head</h1><div class=body><p>{LONGER}</p></div></article>"), f"Head\n{LONGER.strip()}"),
        (page(f"<article><section>{SHORT}</section><section>{LONGER}</section></article>"), f"{SHORT.strip()}\n{LONGER.strip()}"),
        (page(f"<div class=post><section class=section-1><p>{SHORT}</p></section><section class=section-2><p>{LONGER}</p></section></div>"), f"{SHORT.strip()}\n{LONGER.strip()}"),
        (page(f"<div class=post><h1>Head</h1><p>Lead.</p><div class=w><div class=body><p>{LONGER}</p></div></div></div>"), f"Head\nLead.\n{LONGER.strip()}"),
        (page(f"<div class=post><div class=a><p>{SHORT}</p></div><div class=b><div class=c><p>{LONG}</p></div></div><div class=d><p>{LONG}</p></div></div><div class=rail><p>{LONG}</p></div>"), f"{SHORT.strip()}\n{LONG.strip()}\n{LONG.strip()}"),
        (page(f"<article><p>{LONGER}</p></article><div>Printed by no one</div>"), LONGER.strip()),
    ],
)
def test_the_whole_article_is_taken(html, want):
    assert hc.extract(html, None) == want
    for path, _ in hc.ballots(html)[:1]:
        assert hc.extract(html, path) == want


@pytest.mark.parametrize(
    "html,want",
    [
        (page(f"<div class='layout has-sidebar'><article><h1>Head</h1><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div>"), f"Head\n{LONG.strip()}"),
        (page(f"<div class='layout sidebar-right'><article><p>{LONG}</p></article><div class=sidebar><p>{SHORT}</p></div></div><p>Two words</p>"), LONG.strip()),
        (page(f"<div class='content with-comments'><p>{LONG}</p></div><section class=comments><p>{LONG}{LONG}</p></section>"), LONG.strip()),
        (page(f"<div id='search-result-page'><div class=hits><p>{LONG}</p></div></div>"), LONG.strip()),
        (page(f"<article><p>{LONG}</p><section class='related-work'><p>{SHORT}</p></section><div class=share>Share!</div></article>"), f"{LONG.strip()}\n{SHORT.strip()}"),
        (page(f"<div class=widgets><main><p>{LONG}</p></main></div>"), LONG.strip()),
        (page(f"<article><h1>Head</h1><div class='body social'><p>{LONG}</p></div></article>"), f"Head\n{LONG.strip()}"),
        (page(f"<div class='comments'><p>{LONG}</p></div>"), LONG.strip()),
        (page(f"<article><p>{SHORT}</p></article><div class=sidebar><p>{LONGER}</p></div><section class=related><article><p>{LONG}</p></article></section>"), SHORT.strip()),
        (page(f"<article><p>Some <span class=share>Share!</span>words. {LONG}</p></article>"), f"Some words. {LONG.strip()}"),
    ],
)
def test_a_name_alone_is_no_boilerplate(html, want):
    assert hc.extract(html, None) == want


def test_deep_nesting_is_linear():
    import time
    import tracemalloc

    for page in ("<div>" * 100_000 + "deep text", "<x-a class='c1'>" * 100_000 + "<p>deep text", "<b>" * 100_000 + "deep" + "</i>" * 100_000 + " text", "<div><i>" * 50_000 + "deep text" + "</p>" * 50_000):
        tracemalloc.start()
        began = time.perf_counter()
        path = hc.ballots(page)
        assert hc.extract(page, path[0][0] if path else None) == "deep text"
        assert tracemalloc.get_traced_memory()[1] < 200 << 20 and time.perf_counter() - began < 60
        tracemalloc.stop()


def test_against_a_plain_vote(spark):
    """Several templates a host; the winner by counting votes in plain Python, and every page along it."""
    import random

    rng = random.Random(14)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    templates = [
        lambda body: f"<html><body><nav>{words(9)}</nav><div class='wrap w{rng.randrange(9)}'><div class='post-body'>{body}</div></div><footer>{words(9)}</footer></body></html>",
        lambda body: f"<body><div id=sidebar>{words(20)}</div><main><article>{body}</article></main></body>",
        lambda body: f"<body><div class='content'>{body}</div><div class='ads'>{words(30)}</div></body>",
    ]
    rows, want = [], {}
    for k in range(90):
        body = [f"{words(rng.randrange(8, 40))}." for _ in range(rng.randrange(1, 6))]
        rows.append((k, f"http://h{k % 3}.example/{k}", rng.choice(templates[: 1 + k % 3])("".join(f"<p>{b}</p>" for b in body))))
        want[k] = "\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = df.select(hc.host(df.url).alias("host"), "html")
    votes = {}
    for _, url, html in rows:
        for path, share in hc.ballots(html):
            host = url.split("/")[2]
            votes.setdefault(host, {}).setdefault(path, []).append(share)
    plain = {h: max((round(sum(v), 6), p) for p, v in paths.items())[1] for h, paths in votes.items()}
    assert {r.host: r.path for r in hc.winners(own).collect()} == plain
    got = {r.page_id: r.text for r in hc.extract_pages(df).collect()}
    assert got == {k: hc.extract(html, plain[url.split("/")[2]]) for k, url, html in rows} == want


def test_words_in_articles_are_no_marks():
    for inner in ("<div class='social-science'><p>Text of it.</p></div>", "<p id='share'>Text of it.</p>", "<h2 id='related'>Text of it.</h2>"):
        page = f"<body><nav>a b</nav><article><p>{'First words of a long story. ' * 9}</p>{inner}<p>{'Last words of a long story. ' * 9}</p></article></body>"
        assert "Text of it." in hc.extract(page, None).split("\n")
    for inner in ("<div class='ad'>Text of it.</div>", "<p class='sponsored'>Text of it.</p>", "<div class='related-links'><a href=x>Text of it.</a></div>", "<ul class='share'><li>Text of it.</li></ul>"):
        page = f"<body><article><p>{'First words of a long story. ' * 9}</p>{inner}</article></body>"
        assert "Text of it." not in hc.extract(page, None)
