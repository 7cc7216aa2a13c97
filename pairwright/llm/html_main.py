"""Main text of web pages by consensus paths of their host.

Each page's containers are scored by the running text they hold; the best one
votes for its path of tags and classes (digits generalised).  The parts in and
beside it vote as well: each with its own path and a hash of its text.  Votes are summed by
host and path in Spark (partial sums first, so a host with a third of the pages is
no hot group), and every page is extracted again with what won on its host:

* the container: the path with most votes that the page has, else its own best one;
* the other parts: a path whose text mostly comes back with other articles of the
  host is the site's, not the article's.  Where text differs from page to page
  (headings, intros, sibling sections), the part belongs to the article, unless it
  follows an ``article`` or ``main`` element that it is not alike.  Copies of a page
  are no evidence, so a part has to come back beside a different main text.

Names break the ties: where nothing tells parts apart by votes, those named like menus,
headers, footers, sidebars, notices, adverts, forms or reader comments are left out,
and so are those that are mostly links.  The article is widened from the winning
container to the ancestor that holds all containers of its path (its ``main``, if
that holds them all).

A path is one 64-bit number, rolled on from the path above it, and every pass runs
over the elements once, down from parents or up to them: time and memory grow with
the page, not with its depth.

Blocks are the texts between block elements; character references are decoded,
white space (line breaks too) becomes one space.  Markup errors (unclosed or
stray tags, cut references) never raise.

Null or empty html, or one without text: an empty string.  Null or strange urls
form a host of their own.  Repeated rows get equal results; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import stage

WIN_SHARE = 0.2              # of a host's votes that a path needs
SIDE_SHARE = 0.002           # of a host's shares for parts beside the container that a part needs
REPEAT_SHARE = 0.5           # of a part's pages whose text comes back: the part is the site's
BROADCAST_HOSTS = 400_000    # hosts and paths (of 8 bytes) that may be broadcast

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")

# Kinds of elements.
RAW = frozenset("script style noscript template iframe svg textarea title object canvas xmp noembed noframes".split())
_END = {tag: re.compile(rf"</{tag}[^>]*>", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body article main section div td blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th pre figure figcaption "
    "header footer nav aside form fieldset address details summary hr hgroup menu dialog center".split())
LEFT_OUT = frozenset("nav aside footer form menu dialog button select option label input head".split())
ARTICLES = frozenset(("article", "main"))
KEEPS_OPEN = CONTAINERS | frozenset("ul ol table dl".split())     # no paragraph or sibling outside of these is ended
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
LEFT_OUT_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts banner promo "
    "promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay subscribe newsletter "
    "signup login share sharing social related recommended comment comments reply replies respond disqus breadcrumb "
    "breadcrumbs pagination pager search widget skip hidden toolbar topbar gdpr copyright discussion thread "
    "donate donation".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())


@dataclass
class Block:
    at: int                    # the element it stands in
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        text = "".join(self.parts)
        return " ".join((unescape(text) if "&" in text else text).split())


def _step(path: int, tag: str, classes: str = "") -> int:
    """Path of an element below ``path``: order of classes and digits in them do not count."""
    names = sorted({_DIGITS.sub("#", c) for c in classes.lower().split()}) if classes else ()
    return xxh64_intdigest(".".join([tag, *names]).encode("utf-8", "replace"), path)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _attributes(source: str) -> dict[str, str]:
    if len(source) < 2:
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(source)}


def _looks_left_out(tag: str, attrs: dict[str, str]) -> bool:
    if tag in LEFT_OUT or tag == "header":
        return True
    if not attrs:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return (not LEFT_OUT_NAMES.isdisjoint(_NAME_PARTS.findall(names)) or attrs.get("role", "").lower() in LEFT_OUT_ROLES
            or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or "display:none" in attrs.get("style", "").replace(" ", ""))


class Page:
    """Blocks and elements of one page; elements are numbered so that parents come first."""

    def __init__(self, html: str):
        self.tags, self.parent, self.named = ["body"], [-1], [False]
        self.own = [False]                     # a container, or has a class: may be a part of its own
        self.key = [_step(0, "body")]          # path down to the element
        self.path = self.key[:]                # path down to the container it is or stands in
        self.blocks: list[tuple[int, str, int]] = []     # element, text, characters in links
        self._read(html)
        self.chars, self.linked = self._zeros(), self._zeros()
        for at, text, linked in self.blocks:
            self.chars[at] += len(text)
            self.linked[at] += linked
        self._sum_up(self.chars)
        self._sum_up(self.linked)
        self._limit = 0.6 * max(1, self.chars[0])

    def _zeros(self) -> list:
        return [0] * len(self.tags)

    def _sum_up(self, values: list) -> None:
        """Adds to each element's value those of all elements below it."""
        for i in range(len(values) - 1, 0, -1):
            values[self.parent[i]] += values[i]

    def _spread(self, own: list) -> list:
        """Whether the flag is set for an element or one around it."""
        out = own[:]
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def _read(self, html: str) -> None:
        tags, stack, links, skipped = self.tags, [0], 0, 0
        places: dict[str, list[int]] = {}      # where a tag is open in the stack
        known: dict[tuple[int, str, str], int] = {}
        block = Block(0)

        def flush() -> None:
            nonlocal block
            if block.parts:
                if text := block.text():
                    self.blocks.append((block.at, text, min(block.linked, len(text))))
                block = Block(stack[-1])
            else:
                block.at = stack[-1]

        def pop(to: int) -> None:
            nonlocal links, skipped
            for _ in range(len(stack) - to):
                i = stack.pop()
                places[tags[i]].pop()
                links -= tags[i] == "a"
                skipped -= self.named[i] and tags[i] not in BLOCKS

        def innermost(names) -> int:
            return max((places[t][-1] for t in names if places.get(t)), default=0)

        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            text = html[at: m.start() if m else end]
            if text and not skipped:
                # a block stands where its first text does
                if not block.parts and text.strip():
                    block.at = stack[-1]
                block.parts.append(text)
                block.linked += len(text) * (links > 0)
            if not m:
                break
            at = m.end()
            slash, tag, rest = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if tag in BLOCKS:
                    flush()
                if where := innermost((tag,)):
                    pop(where)
                if tag in BLOCKS:
                    block.at = stack[-1]
                continue
            if tag in RAW:
                close = _END[tag].search(html, at)
                at = close.end() if close else end
                block.parts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    block.parts.append(" ")
                continue
            if tag in ("body", "html"):
                flush()
                continue
            if tag in BLOCKS:
                flush()
                # a block element ends an open paragraph, or a sibling
                where = innermost(("p", *CLOSES.get(tag, ())))
                if where and where >= innermost(KEEPS_OPEN):
                    pop(where)
            attrs = _attributes(rest)
            up = stack[-1]
            tags.append(tag)
            self.parent.append(up)
            self.named.append(_looks_left_out(tag, attrs))
            at_path = self.path[up]
            step = (at_path, tag, attrs["class"] if "class" in attrs else "")
            self.own.append("class" in attrs or tag in CONTAINERS)
            if (key := known.get(step)) is None:
                key = known[step] = _step(*step)
            self.key.append(key)
            self.path.append(key if tag in CONTAINERS else at_path)
            if not rest.endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(tags) - 1)
                links += tag == "a"
                skipped += self.named[-1] and tag not in BLOCKS
            if tag in BLOCKS:
                block.at = stack[-1]
        flush()

    def _left_out_within(self, top: int) -> list[bool]:
        """By element: whether it belongs to a part named as left out, of those below ``top`` (-1: all)."""
        out, header = [False] * len(self.tags), [False] * len(self.tags)
        for i in range(max(top, 0), len(out)):
            if i == top:
                continue
            up, tag = self.parent[i], self.tags[i]
            if up >= 0:
                out[i], header[i] = out[up], header[up]
            # a part with most of the text is a layout's name, not a menu's; headings stay in an article's header
            if self.named[i] and self.chars[i] < self._limit:
                if tag == "header" and top:
                    header[i] = True
                else:
                    out[i] = True
            if tag in HEADINGS:
                header[i] = False
        return [a or b for a, b in zip(out, header)]

    def best(self) -> tuple[float, int]:
        """Score and number of the deepest container that holds nearly as much as any: running text,
        less what would be left out."""
        bad = self._left_out_within(-1)
        kept, lost = self._zeros(), self._zeros()
        for at, text, _ in self.blocks:
            if bad[at]:
                lost[at] += len(text)
            else:
                kept[at] += len(text) * (1 - self.linked[at] / max(1, self.chars[at]))
        self._sum_up(kept)
        self._sum_up(lost)
        scores = [((1.3 if tag in ARTICLES else 1.0) * (kept[i] - 0.5 * lost[i]), i)
                  for i, tag in enumerate(self.tags) if tag in CONTAINERS and kept[i] > 0]
        if not scores:
            return 0.0, 0
        top = max(s for s, _ in scores)
        return max(((s, i) for s, i in scores if s >= 0.9 * top or s == top), key=lambda x: x[1])

    def place(self, paths: list[int]) -> int:
        """The container of the first of ``paths`` that holds text here, else the best one."""
        rank = {path: k for k, path in enumerate(paths)}
        named = self._spread(self.named)
        held = [(rank[self.path[i]], named[i], -self.chars[i], i) for i, tag in enumerate(self.tags)
                if tag in CONTAINERS and self.chars[i] and self.path[i] in rank]
        return min(held)[3] if held else self.best()[1]

    def _around(self, within: int) -> list[int]:
        """``within`` and the elements around it, up to a ``main`` that holds all containers of its path."""
        alike = [int(tag in CONTAINERS and self.chars[i] > 0 and self.path[i] == self.path[within])
                 for i, tag in enumerate(self.tags)]
        total = sum(alike)
        self._sum_up(alike)
        out, at = [], within
        while at >= 0:
            out.append(at)
            if self.tags[at] == "main" and alike[at] == total:
                break
            at = self.parent[at]
        return out

    def parts(self, within: int) -> tuple[dict[int, list[int]], dict[int, int], list[int]]:
        """Blocks by the part they stand in, the parts' paths, and the elements around ``within``.

        A part is a child of an element around ``within`` with all it holds (its number), or a block straight
        in such an element (minus one less its number).  Children of ``within`` that are containers or have a
        class are parts as well; all else in it is the part ``within``.
        """
        around = self._around(within)
        chain, top = set(around), around[-1]
        part: list[int | None] = [None] * len(self.tags)
        part[within] = within
        for i in range(top + 1, len(part)):
            if i not in chain:
                up = self.parent[i]
                part[i] = i if up in chain and (up != within or self.own[i]) else part[up]
        blocks: dict[int, list[int]] = {}
        keys: dict[int, int] = {}
        for k, (at, _, _) in enumerate(self.blocks):
            p = part[at]
            if p is None:
                if at not in chain:
                    continue
                p = -1 - k
                keys[p] = _step(self.path[at], "#text")
            elif p not in keys:
                keys[p] = self.key[p]
            blocks.setdefault(p, []).append(k)
        return blocks, keys, around

    def _is_inside(self, part: int, within: int) -> bool:
        return part == within or part >= 0 and self.parent[part] == within

    def _is_most(self, part: int, within: int) -> bool:
        """Whether a part holds most of the container: then it is the article, whatever comes back."""
        return part == within or self._is_inside(part, within) and 2 * self.chars[part] >= self.chars[within]

    def votes(self) -> dict | None:
        """What the page says about its host: the container's path, and the parts in and beside it."""
        score, within = self.best()
        if score <= 0:
            return None
        blocks, keys, _ = self.parts(within)

        def said(ks: list[int]) -> int:
            return _signed(xxh64_intdigest(_DIGITS.sub("#", "\n".join(self.blocks[k][1] for k in ks))))

        main = [k for p, ks in blocks.items() if self._is_inside(p, within) for k in ks]
        sides = [p for p in blocks if not self._is_most(p, within)]
        return {"path": _signed(self.path[within]), "weight": min(1.0, score / max(1, self.chars[0])), "main": said(sorted(main)),
                "sides": [{"part": _signed(keys[p]), "said": said(blocks[p]), "share": 1.0 / len(sides)} for p in sides]}

    def text(self, paths: list[int], repeated: frozenset[int] = frozenset()) -> str:
        """Blocks of the article: those of the container that won, and of the parts beside it that are
        neither among the host's ``repeated`` ones nor, by name, links or place, something else."""
        within = self.place(paths)
        blocks, keys, around = self.parts(within)
        inside = self._left_out_within(within)
        beside = self._left_out_beside(within, around)
        alike = self._spread([tag in CONTAINERS and self.path[i] == self.path[within] for i, tag in enumerate(self.tags)])
        heading = self._spread([tag in HEADINGS for tag in self.tags])
        # elements around the outermost ``article`` or ``main``: what follows in them is not the article's
        ends = [k for k, i in enumerate(around) if self.tags[i] in ARTICLES]
        beyond = set(around[ends[-1] + 1:]) if ends else set()
        begun = min((ks[0] for p, ks in blocks.items() if self._is_inside(p, within)), default=0)
        out = []
        for p, ks in blocks.items():
            if keys[p] in repeated and not self._is_most(p, within):
                continue
            if self._is_inside(p, within):
                out += [k for k in ks if not inside[self.blocks[k][0]]]
                continue
            ks = [k for k in ks if not beside[self.blocks[k][0]]]
            if ks and not any(alike[self.blocks[k][0]] for k in ks):
                up = self.parent[p] if p >= 0 else self.blocks[ks[0]][0]
                if up in beyond and ks[0] > begun:
                    continue
                plain = [self.blocks[k] for k in ks if not heading[self.blocks[k][0]]]
                chars = sum(len(text) for _, text, _ in plain)
                if chars and 2 * sum(linked for _, _, linked in plain) >= chars:
                    continue
            out += ks
        return "\n\n".join(self.blocks[k][1] for k in sorted(out))

    def _left_out_beside(self, within: int, around: list[int]) -> list[bool]:
        """By element beside ``within``: whether it belongs to a part named as left out, whatever its size."""
        chain = set(around)
        holds = [int(n) for n in self.named]
        self._sum_up(holds)
        out, header, below_body = ([False] * len(self.tags) for _ in range(3))
        for i in range(1, len(out)):
            if i in chain:
                continue
            up, tag = self.parent[i], self.tags[i]
            out[i], header[i] = out[up], header[up]
            below_body[i] = up == 0 or (up not in chain and below_body[up])
            if self.named[i] and not (self.named[within] and self.path[i] == self.path[within]):
                # the title in an article's header counts, a site's header with its menus does not
                if tag == "header" and not below_body[i] and holds[i] == 1:
                    header[i] = True
                else:
                    out[i] = True
            if tag in HEADINGS:
                header[i] = False
        return [a or b for a, b in zip(out, header)]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: ``host, paths`` (of containers, most votes first) and ``repeated`` (paths of the
    parts in and beside them that are the site's), as numbers.

    Both lists are bounded: a container's path needs ``WIN_SHARE`` of the host's votes, a part's path
    ``SIDE_SHARE`` of the shares that the pages give to their parts (one a page in all).
    """
    kind = pa.struct([("path", pa.int64()), ("weight", pa.float64()), ("main", pa.int64()),
                      ("sides", pa.list_(pa.struct([("part", pa.int64()), ("said", pa.int64()), ("share", pa.float64())])))])

    @F.arrow_udf("struct<path:bigint,weight:double,main:bigint,sides:array<struct<part:bigint,said:bigint,share:double>>>")
    def vote(column: pa.Array) -> pa.Array:
        return pa.array([Page(cell.as_py() or "").votes() for cell in column], kind)

    votes = stage(pages.select(host_of(F.col(url_col)).alias("host"), vote(html_col).alias("v"))
                       .filter("v is not null").select("host", "v.*"), "html-votes")

    def by_share(sums: DataFrame, least: float) -> DataFrame:
        totals = sums.groupBy("host").agg(F.sum("votes").alias("all"))
        return sums.join(totals, "host").filter(F.col("votes") >= least * F.col("all"))

    won = by_share(votes.groupBy("host", "path").agg(F.sum("weight").alias("votes")), WIN_SHARE)
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("votes", 6)).alias("v"), "path")))
    won = won.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths"))

    said = votes.select("host", "main", F.inline("sides")).groupBy("host", "part", "said") \
                .agg(F.sum("share").alias("votes"), F.count(F.lit(1)).alias("n"), (F.min("main") != F.max("main")).alias("again"))
    part = said.groupBy("host", "part").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"),
                                            F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("again"))
    site = by_share(part, SIDE_SHARE).filter(F.col("again") >= REPEAT_SHARE * F.col("n"))
    site = site.groupBy("host").agg(F.collect_list("part").alias("repeated"))
    return won.join(site, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars``."""

    @F.arrow_udf("string")
    def extract(html: pa.Array, paths: pa.Array, repeated: pa.Array) -> pa.Array:
        whole = (1 << 64) - 1
        return pa.array([Page(h.as_py() or "").text([k & whole for k in p.as_py() or ()],
                                                    frozenset(k & whole for k in r.as_py() or ()))
                         for h, p, r in zip(html, paths, repeated)], pa.string())

    won = stage(consensus(pages, url_col, html_col), "html-paths")
    keys = won.agg(F.sum(1 + F.size("paths") + F.coalesce(F.size("repeated"), F.lit(0)))).first()[0] or 0
    small = keys <= broadcast_hosts
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"),
                        host_of(F.col(url_col)).alias("_host"))
    won = won.select(F.col("host").alias("_host"), F.col("paths").alias("_paths"), F.col("repeated").alias("_repeated"))
    rows = rows.join(F.broadcast(won) if small else won, "_host", "left")
    return rows.select(id_col, url_col, extract("_html", "_paths", "_repeated").alias("text")) \
               .withColumn("n_chars", F.char_length("text").cast("bigint"))
