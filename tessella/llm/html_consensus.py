"""HTML extraction by consensus host paths.

1. Every page is parsed and its containers are scored by all text in them, links discounted, nested text by a share.
2. Its best paths vote, by generalised tag-class path (digits in classes do not count), for their host. The votes are
   summed in Spark, with partial sums, so a host of any size costs one row for each path and task.
3. Every page is extracted again from all containers on its host's winning path, widened to the article or main around them,
   or else to elements of whose text they hold the better part. A page without one, or where they hold far less than the
   page's own best path, uses that one instead.

Boilerplate subtrees (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) count
neither as votes nor as text. What is one by its class, id or role alone is decided when the page is read: an element around
main, around the page's only article, or around most of its text stays, and all of them stay if no text were left. In an
article, a name that only holds such a word among others (``social-science``) marks an element if most of its text is in
links; paragraphs and headings are marked by classes that mean adverts alone.

Defined results
---------------
* null, empty or textless html: the empty text; a null url, or one without ``://``, belongs to the host ````;
* tied paths: the larger summed score, then the path that sorts last; repeated rows are all returned;
* nesting of any depth: a page costs memory and time in proportion to its length;
* unclosed, crossed and cut tags are tolerated: a block start ends an open paragraph, an end tag without its start is
  ignored; an empty table gives an empty result; extra columns are ignored.

Winning paths are broadcast while they number at most ``MOST_HOSTS`` and are joined by a shuffle of hosts, salted, beyond.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

MOST_HOSTS = 50_000
#: Paths of a page that vote.
VOTES = 3
#: A page keeps its own best path if its host's holds less than this share of that one's score.
FAR_LESS = 0.25
SALTS = 64
#: What a container scores of each one in it, and what the page's outermost elements do.
CARRIED, CARRIED_OUT = 0.7, 0.5
#: A winning path widens to an element around it of whose text it holds so much, and to the whole page from so much on.
MOST_OF_ELEMENT, MOST_OF_PAGE = 0.5, 0.8

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr address summary".split())
LISTS = frozenset("ul ol dl table tbody thead figure".split())
#: The elements that authors put around a page's text, and those around a page.
STORY = frozenset(["article", "main"])
OUTER = frozenset(["html", "body"])
#: A cell is parted from the next by a space, not by a new block.
CELLS = frozenset(["td", "th"])
NEVER_TEXT = frozenset("nav footer aside button dialog menu head noscript template svg math select object datalist".split())
#: Words of a class, id or role that mark boilerplate.
BOILERPLATE = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification paywall pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
#: Classes that mark a paragraph or heading too.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising promo sponsored".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: An article of such a class is not the page's.
MINOR_ARTICLE = frozenset("comment comments promo related reply respond teaser".split())
#: Names of what an element has or lacks, or that only sound like a mark.
NO_MARK = re.compile(r"\b(?:has|have|with|without|no|not)[-_]+[a-z]+|\brelated[-_]+works?\b")
#: A marked element with this share of a page's text is not its boilerplate.
MOST_IN_MARK = 0.75
#: Elements that end an open one of the same kind; any element that is neither inline nor void ends an open p.
ENDS_ITSELF = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
BARRIERS = frozenset("table ul ol dl div section article main body".split())

TOKEN = re.compile(r"""<(?:(?P<comment>!--)|(?P<decl>[!?])|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*+"|'[^']*+')*+)>|(?P<loose>/?[a-zA-Z][^>]*+)>?)""")
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """A parsed page: elements as parallel lists, and blocks of text."""

    def __init__(self, html: str | None, keep_forms: bool = False):
        self.keep_forms = keep_forms
        self.parent, self.tag, self.path, self.dropped, self.main = [-1], ["#"], [0], [False], [False]
        self.block = [0]  # the nearest element, itself or above, that is not inline
        self.steps: list[tuple[int, str]] = [(-1, "")]  # paths by number: the path before, and the last step
        self.numbers: dict[tuple[int, str], int] = {}
        self.count: dict[str, int] = {}  # open elements by tag
        self.marked, self.minor = [0], [False]  # the nearest element at or above that is named like boilerplate
        self.weak: set[int] = set()  # marked elements that are boilerplate only if they are mostly links
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.runs: list[tuple[int, list[tuple[str, int, bool]]]] = []  # element; texts, their marks, whether in a link
        self.run: list[tuple[str, int, bool]] = []
        self.at = 0  # the open element
        self.links = 0
        if html:
            self.parse(html)
        self.flush()
        self.settle()

    def parse(self, html: str) -> None:
        pos, n = 0, len(html)
        while pos < n:
            lt = html.find("<", pos)
            if lt < 0:
                self.text(html[pos:])
                return
            if lt > pos:
                self.text(html[pos:lt])
            m = TOKEN.match(html, lt)
            if m is None:
                self.text("<")
                pos = lt + 1
            elif m["comment"]:
                end = html.find("-->", lt + 4)
                pos = n if end < 0 else end + 3
            elif m["decl"]:
                end = html.find(">", lt)
                pos = n if end < 0 else end + 1
            elif m["loose"] is not None:
                pos = m.end()  # a quote or tag that never ends
            else:
                pos = m.end()
                tag = m["tag"].lower()
                if m["end"]:
                    self.close(tag)
                elif tag in RAW:
                    if not m["attrs"].endswith("/") or tag in ("script", "style"):
                        end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, pos)
                        pos = n if end is None else end.end()
                    if tag not in ("script", "style", "template"):
                        self.text(" ")
                elif tag in VOID:
                    if tag == "hr":
                        self.flush()
                    elif tag in ("br", "wbr"):
                        self.text(" " if tag == "br" else "")
                else:
                    self.open(tag, m["attrs"])

    def text(self, s: str) -> None:
        if s and not self.dropped[self.at]:
            s = entities.unescape(s) if "&" in s else s
            self.run.append((s, self.marked[self.at], self.links > 0))

    def flush(self) -> None:
        if self.run:
            self.runs.append((self.block[self.at], self.run))
            self.run = []

    def settle(self) -> None:
        """Makes blocks of what does not lie in boilerplate."""
        gone = self.boilerplate()
        for at, run in self.runs:
            kept = [x for x in run if not gone.get(x[1])] if gone else run
            if text := " ".join("".join(s for s, _, _ in kept).split()):
                self.blocks.append((at, text, sum(len(s) for s, _, linked in kept if linked)))
        self.runs = []

    def boilerplate(self) -> dict[int, bool]:
        """Whether each marked element goes. One that holds the page's article, or most of its text, is no boilerplate."""
        n = len(self.tag)
        marks = [k for k in range(1, n) if self.marked[k] == k]
        if not marks:
            return {}
        story = [0]
        for k in range(1, n):
            story.append(k if self.tag[k] in STORY and not self.dropped[k] else story[self.parent[k]])
        # by nearest mark: characters out of links; articles with such text; main elements
        size, told, mains, links = dict.fromkeys([0, *marks], 0), set(), dict.fromkeys([0, *marks], 0), dict.fromkeys([0, *marks], 0)
        for at, run in self.runs:
            for s, mark, linked in run:
                own = len("".join(s.split()))
                if linked:
                    links[mark] += own
                    own = 0
                size[mark] += own
                at_story = story[at] if own else 0
                while at_story and at_story not in told and self.marked[at_story] == mark:
                    told.add(at_story)
                    at_story = story[self.parent[at_story]]
        direct = dict.fromkeys(size, 0)
        for k in told:
            direct[self.marked[k]] += 1
        for k in range(1, n):
            if self.tag[k] == "main" and not self.dropped[k]:
                mains[self.marked[k]] += 1
        own, inner = dict(size), dict(direct)
        for m in reversed(marks):
            up = self.marked[self.parent[m]]
            size[up] += size[m]
            links[up] += links[m]
            inner[up] += inner[m]
            mains[up] += mains[m]
        gone, clear, left = {0: False}, direct[0], own[0]
        for m in sorted(marks, key=lambda m: (-size[m], m)):  # an element before those in it
            most, half = size[m] >= MOST_IN_MARK * size[0] > 0, 2 * size[m] >= size[0] > 0
            within = story[self.parent[m]] > 0
            keep = m in self.weak and size[m] >= links[m] or mains[m] or inner[m] and most or not self.minor[m] and (most and (within or not clear) or inner[m] and half and not clear)
            gone[m] = gone[self.marked[self.parent[m]]] or not keep
            if not gone[m]:
                clear += direct[m]
                left += own[m]
        return gone if left else {}

    def open(self, tag: str, attrs: str) -> None:
        inline = tag in INLINE
        if not inline:
            if tag in CELLS:
                self.run.append((" ", 0, False))
            else:
                self.flush()
            self.end_open(frozenset(["p"]) if tag not in ENDS_ITSELF else ENDS_ITSELF[tag] | {"p"})
        words, tokens, classes, hidden, shown = set(), set(), set(), False, tag
        if attrs:
            for name, *value in NAMED.findall(attrs):
                name, value = name.lower(), entities.unescape("".join(value))
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
                elif name in ("class", "id", "role"):
                    words.update(WORD.findall(NO_MARK.sub(" ", CAMEL.sub("-", value).lower())))
                    tokens.update(value.lower().split())
                    if name == "class":
                        classes.update(value.lower().split())
                    if name == "class" and not inline:
                        shown += "".join(f".{re.sub(r'[0-9]+', '#', c)}" for c in sorted(value.replace("/", "_").split()))
        up = self.at
        # a header in the article is no boilerplate; elements with names of such are looked at when the page is read
        drop = hidden or tag in NEVER_TEXT or tag == "form" and not self.keep_forms or tag == "header" and not self.main[up]
        mark = tag not in ("html", "body", "main") and bool(classes & ADVERTS if tag in LINES else words & (MINOR_ARTICLE if tag == "article" else BOILERPLATE))
        if mark and self.main[up] and not tokens & BOILERPLATE:
            self.weak.add(len(self.tag))
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self.path[up] if inline else self.number(self.path[up], shown))
        self.block.append(self.block[up] if inline else len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.dropped.append(self.dropped[up] or drop)
        self.marked.append(len(self.tag) - 1 if mark else self.marked[up])
        self.minor.append(bool(words & MINOR_ARTICLE))
        self.main.append(self.main[up] or tag in ("article", "main"))
        if drop and not inline:
            self.run = []
        self.at = len(self.tag) - 1
        self.links += tag == "a"

    def number(self, before: int, step: str) -> int:
        key = before, step
        if (k := self.numbers.get(key)) is None:
            k = self.numbers[key] = len(self.steps)
            self.steps.append(key)
        return k

    def written(self, path: int) -> str:
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append(step)
        return "/".join([*out, ""][::-1])

    def found(self, written: str) -> int:
        """The number of a written path; -1 if the page has none such."""
        k = 0
        for step in written.split("/")[1:]:
            if (k := self.numbers.get((k, step), -1)) < 0:
                return -1
        return k

    def end_open(self, tags: frozenset[str]) -> None:
        """Ends the nearest open element of ``tags`` unless another container lies between."""
        if not any(self.count.get(t) for t in tags):
            return
        at = self.at
        while at > 0 and self.tag[at] not in BARRIERS:
            if self.tag[at] in tags:
                self.leave(self.parent[at])
                return
            at = self.parent[at]

    def close(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag not in INLINE and tag not in CELLS:
            self.flush()
        if not self.count.get(tag):
            return
        at = self.at
        while at > 0 and self.tag[at] != tag:
            if tag in INLINE and self.tag[at] not in INLINE or tag in PARAGRAPHS and self.tag[at] in BARRIERS:
                return
            at = self.parent[at]
        if at > 0:
            self.leave(self.parent[at])

    def leave(self, to: int) -> None:
        at = self.at
        while at != to:
            self.links -= self.tag[at] == "a"
            self.count[self.tag[at]] -= 1
            at = self.parent[at]
        self.at = to

    # -- containers

    def weigh(self) -> dict[int, float]:
        """Scores by path of containers: their own text and a share of what the containers in them score."""
        n = len(self.tag)
        held = [0]  # the container of each element: itself, or the one around a paragraph, list, table or inline element
        for k in range(1, n):
            held.append(held[self.parent[k]] if self.tag[k] in PARAGRAPHS or self.tag[k] in INLINE or self.tag[k] in LISTS else k)
        score, below = [0.0] * n, [0.0] * n
        for at, text, linked in self.blocks:
            own = max(0.0, len(text) - 2.0 * linked) * (1.0 if self.tag[at] in PARAGRAPHS else 0.6)
            score[held[at]] += own
            below[held[at]] += own
        for k in range(n - 1, 0, -1):  # parents come before their children
            if below[k] > 0:
                up = held[self.parent[k]]
                below[up] += below[k]
                if up > 0:
                    score[up] += score[k] * (CARRIED_OUT if self.tag[up] in OUTER else CARRIED)
        self.held, self.below = held, below
        found: dict[int, float] = {}
        for k in range(n):
            if score[k] > 0:
                found[self.path[k]] = found.get(self.path[k], 0.0) + score[k] * (1.5 if self.tag[k] in STORY else 1.0)
        return found

    def region(self, path: int) -> set[int]:
        """The containers on ``path``, each widened to its article, then all of them to what they hold the better part of."""
        tops, story = set(), [0]
        for k in range(len(self.tag)):
            if k:
                story.append(k if self.tag[k] in STORY else story[self.parent[k]])
            if self.below[k] > 0 and self.path[k] == path:
                tops.add(story[k] or k)
        covered = self.covered(tops)
        tops = {t for t in tops if t == 0 or not covered[self.parent[t]]}
        own = sum(self.below[t] for t in tops)
        stories = any(self.tag[t] in STORY for t in tops)
        up = self.shared(tops)
        while up >= 0:
            outer = up == 0 or self.tag[up] in OUTER
            if outer and stories or own < (MOST_OF_PAGE if outer else MOST_OF_ELEMENT) * self.below[up]:
                break
            tops = {up}
            up = self.held[self.parent[up]] if up else -1
        return tops

    def shared(self, tops: set[int]) -> int:
        """The smallest container around all of ``tops``, -1 if there is none."""
        low = sorted(tops)
        if len(low) == 1:
            return self.held[self.parent[low[0]]] if low[0] else -1
        at = low[0]
        for other in low[1:]:
            while at != other:
                if at > other:
                    at = self.parent[at]
                else:
                    other = self.parent[other]
        return self.held[at]

    def covered(self, tops: set[int]) -> list[bool]:
        """Whether each element lies in one of ``tops``."""
        covered = [0 in tops]
        for k in range(1, len(self.tag)):
            covered.append(k in tops or covered[self.parent[k]])
        return covered

    def taken(self, tops: set[int]) -> str:
        covered = self.covered(tops)
        return "\n".join(text for at, text, _ in self.blocks if covered[at])


def best(scores: dict[int, float]) -> list[tuple[int, float]]:
    """Paths from the best; of equals the earlier one."""
    return sorted(scores.items(), key=lambda x: -x[1])


def ballots(html: str | None) -> list[tuple[str, float]]:
    """(path, share of the page's score) of its best paths."""
    page = Page(html)
    own = best(page.weigh())[:VOTES]
    total = sum(v for _, v in own)
    return [(page.written(path), v / total) for path, v in own]


def extract(html: str | None, path: str | None) -> str:
    page = Page(html)
    scores = page.weigh()
    if not scores:  # some pages lie in a form as a whole
        page = Page(html, keep_forms=True)
        scores = page.weigh()
    if not scores:
        return page.taken({0})
    own, most = best(scores)[0]
    won = page.found(path) if path is not None else -1
    return page.taken(page.region(won if scores.get(won, 0.0) >= FAR_LESS * most else own))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the path that got most votes of each host in ``pages`` (host, html)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            hosts, paths, shares = [], [], []
            for h, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, share in ballots(text):
                    hosts.append(h)
                    paths.append(path)
                    shares.append(share)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "share"])

    votes = pages.mapInArrow(vote, "host string, path string, share double").groupBy("host", "path").agg(F.sum("share").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct(F.round("votes", 6).alias("votes"), "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most_hosts: int = MOST_HOSTS) -> DataFrame:
    """(key, url, text, n_chars) of each row."""
    common.ready(pages)
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    won = common.cut(winners(own.select("host", "html")))
    kind = own.schema["key"].dataType.simpleString()

    def take(rows, of) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(rows, "html"):
            texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), of(batch), strict=True)]
            yield pa.record_batch([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"])

    listed = won.limit(most_hosts + 1).collect()
    if len(listed) <= most_hosts:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.path for r in listed})
        done = own.mapInArrow(lambda b: take(b, lambda x: [shared.value.get(h) for h in x.column("host").to_pylist()]), f"key {kind}, url string, text string")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
        done = joined.select("key", "url", "html", "path").mapInArrow(lambda b: take(b, lambda x: x.column("path").to_pylist()), f"key {kind}, url string, text string")
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
