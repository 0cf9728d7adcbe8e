"""Operator 3. Main text of web pages, by paths that a host's pages agree on.

1. Each page is read once into its containers (body, main, article, section, div, table cells), and each container is
   scored by its text outside links and outside parts that are never main text. From the best one the page's *pick* goes
   outwards as long as what a parent adds (a title, a lead, an ending) isn't mostly links; an article or main ends this.
   It and the best few inside it vote for their *path*: the tags and classes from the body down, with digits generalised
   (``div.post-#``).
2. Spark sums the votes by host and path and ranks the paths of each host.
3. Each page is read again with its host's paths. The first of them, where it holds all of the page's own pick, is the main
   text; else all parts with the pick's path are if that is one of the host's, else the pick alone. Other parts than the pick
   count only if they aren't mostly links. The hosts' paths are written first, so that Spark knows their
   size before it plans the join: below its limit it sends them to all tasks and no page moves; above, it deals pages by
   host and splits a host with very many pages.

Blocks are parted at block-level tags and line breaks. Inside a block, white space becomes one space; character
references are decoded; blocks are joined by ``\\n`` in page order. A form is left out, unless it has as much text as the rest of its page.

Defined cases. A null or empty html, and a page without any main text, give the empty text. A null url belongs to the host
``''``, like one without a host. Tags that are never closed end with their parent; stray end tags are passed over; a page
that breaks off ends there. Rows that repeat are extracted one by one; ids and urls may be null. Ties between a
page's containers: the outer or earlier one; between a host's paths: the first in string order. Very long and deeply nested pages cost time and memory in proportion to their length. Other columns of
the input, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from heapq import nsmallest
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidelog.llm._common import materialize, slices

#: Paths that a page votes for at most, and that a host keeps.
VOTES, WINNERS = 3, 3

#: Tags whose whole content is never main text.
DROPPED = frozenset("head script style noscript template iframe svg canvas object nav footer aside form button select textarea dialog menu title".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template"])
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tr th figure figcaption header address details summary fieldset hr br html".split())
BORDERS = BLOCKS | frozenset("nav footer aside form dialog menu".split())
WHOLE = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class and id names, and roles, of parts that are not main text.
AWAY = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices
    alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social sidebar sidebars rail menu menus nav navbar
    navigation topnav breadcrumb breadcrumbs footer foot comment comments commentlist disqus reply replies respond discussion responses related recommended recommendations
    widget widgets pagination pager toolbar masthead disclaimer login search hidden teaser teasers links skip tags""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words in the names of parts whose own header, with the title, belongs to the main text.
CONTENT = frozenset("content article post entry story hentry".split())
#: Words that say a name is about the layout around such a part, not about the part.
LAYOUT = frozenset("layout page columns cols grid".split())
AROUND = frozenset("with has no".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion responses".split())
#: Words that tell about a part only as the last one of its name: a ``hidden-gem`` isn't hidden.
LAST_ONLY = frozenset("hidden skip links tags search rail foot".split())

#: Words that may follow the first one by which a name tells: they say what sort of part it is (``ad-container``), and not
#: what it is about (``related-work``, ``notice-of-motion``).
SORTS = frozenset(
    """area bar block blocks body bottom box btn button buttons center column container content desktop dialog feed field form grid group head header heading icon icons image inline inner
    item items label layer left level link list main message mobile module outer panel placeholder popover posts primary right row secondary section slot small space strip text title top unit
    view wrap wrapper zone""".split()
)

#: A comment; a tag with its attributes, where quotes count only after ``=``; a tag that breaks off; a declaration.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _away(names: str) -> str | None:
    """The word by which a class or id attribute tells that the part is not main text: its last (``site-footer``), unless
    the name is about a layout around such a part (``has-sidebar``), or its first, where the others only say what sort of part it
    is (``ad-container``)."""
    for name in names.split():
        words = [w.lower() for w in _NAME_PARTS.findall(name)]
        if words and words[-1] in AWAY and not AROUND.intersection(words[:-1]):
            return words[-1]
        if words and words[0] in AWAY and words[0] not in LAST_ONLY and all(w in SORTS or w in AWAY or len(w) == 1 for w in words[1:]):
            return words[0]
    return None


class _Open:
    """An open tag. ``inner``: in an article, a main or a part named as content; ``comments``: in readers' comments; ``form``: the number
    of the form for which alone it is dropped."""

    __slots__ = ("tag", "dropped", "container", "inner", "comments", "form")

    def __init__(self, tag: str, dropped: bool, container: int, inner: bool, comments: bool, form: int | None = None):
        self.tag, self.dropped, self.container, self.inner, self.comments, self.form = tag, dropped, container, inner, comments, form


def _inline_ends(html: str) -> tuple[dict[int, int], dict[int, int]]:
    """By the place of an inline tag: where its own end tag ends, counting those that nest; and where the next block begins or ends. An
    inline tag that is open when a tag around it ends, or when a block begins in its paragraph, has no end of its own."""
    ends: dict[int, int] = {}
    borders: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    waiting: list[int] = []
    blocks: list[str] = ["html"]  # those of the stack that are blocks
    at = 0

    def leave() -> tuple[str, int]:
        tag, place = stack.pop()
        opened[tag] -= 1
        if tag in BLOCKS:
            blocks.pop()
        return tag, place

    while m := _TAG.search(html, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in VOID:
            continue
        block = tag in BORDERS
        if block:
            borders.update((place, m.start()) for place in waiting)
            waiting.clear()
        if m[1] or m[4]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    leave()
                _, place = leave()
                if not block:
                    ends[place] = at
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCKS and blocks[-1] == "p":
            while leave()[0] != "p":
                pass
        stack.append((tag, m.start()))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCKS:
            blocks.append(tag)
        if not block:
            waiting.append(m.start())
    return ends, borders


class Page:
    """A page's blocks, each with the container that it is in, and the containers with their parents and paths.

    A path is a number, found by its parent's number and its last step; as a string it is made only where it is wanted. So
    time and memory grow with the page's length, however deep it nests.
    """

    def __init__(self, html: str | None, by_name: bool = True, whole_forms: frozenset[int] = frozenset()):
        self.paths: list[int] = [0]
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["html"]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters outside links
        self.in_forms: list[int] = []  # characters of text that are left out only as they are in a form, by form
        self._numbers: dict[tuple[int, str], int] = {}
        self._steps: list[tuple[int, str]] = [(0, "")]
        self._read(html or "", by_name, whole_forms)

    def path(self, number: int) -> str:
        """A path's steps, parted by ``>``."""
        steps = []
        while number:
            number, step = self._steps[number]
            steps.append(step)
        return ">".join(reversed(steps))

    def number(self, path: str) -> int:
        """The number of a path; -1 if no container of this page has it."""
        at = 0
        for step in path.split(">"):
            at = self._numbers.get((at, step), -1)
            if at < 0:
                break
        return at

    def _add(self, tag: str, step: str, parent: int) -> int:
        above = self.paths[parent]
        number = self._numbers.get((above, step))
        if number is None:
            number = self._numbers[above, step] = len(self._steps)
            self._steps.append((above, step))
        self.paths.append(number)
        self.parents.append(parent)
        self.tags.append(tag)
        return len(self.paths) - 1

    def _read(self, html: str, by_name: bool, whole_forms: frozenset[int]) -> None:
        stack = [_Open("html", False, 0, False, False)]
        opened: dict[str, int] = {}  # how many of a tag are open
        endless: set[str] = set()  # tags that end nowhere in the rest of the page
        parts: list[str] = []
        linked = depth_of_link = 0
        at = forms = 0
        inline = None

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1].container, text, max(0, len(text) - linked)))
                parts.clear()
            linked = 0

        def leave() -> None:
            opened[stack.pop().tag] -= 1

        def end_of(tag: str) -> int:
            """Where the next end tag of ``tag`` ends; -1 if there is none."""
            if tag not in endless:
                if end := re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at):
                    return end.end()
                endless.add(tag)
            return -1

        while m := _TAG.search(html, at):  # from where the last tag, or what it left out, ended
            if m.start() > at and not stack[-1].dropped:
                piece = html[at : m.start()]
                parts.append(piece)
                if depth_of_link:
                    linked += len(piece)
            elif m.start() > at and stack[-1].form is not None and not depth_of_link:
                self.in_forms[stack[-1].form] += len(html[at : m.start()].strip())
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attrs = (m[1], m[3]) if m[2] else (m[4], m[6])
            if closing:
                if tag == "a":
                    depth_of_link = max(0, depth_of_link - 1)
                elif opened.get(tag):
                    if not stack[-1].dropped:
                        flush()
                    while stack[-1].tag != tag:
                        leave()
                    leave()
                continue
            if tag == "a":
                depth_of_link += 1
                continue
            if tag in RAW:
                end = end_of(tag)
                at = end if end >= 0 else len(html)
                continue
            if tag in VOID or tag not in BLOCKS and tag not in DROPPED and not (attrs and "=" in attrs or "hidden" in attrs):
                if tag in ("br", "hr") and not stack[-1].dropped:
                    flush()
                continue
            own = {}
            if attrs:
                own = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(attrs)}
            names = f"{own.get('class', '')} {own.get('id', '')}"
            inner = stack[-1].inner
            by = form = None
            whole = False
            if tag == "form" and stack[-1].form is None and not stack[-1].dropped:
                form, forms = forms, forms + 1
                self.in_forms.append(0)
                whole = form in whole_forms
            if tag in DROPPED and not whole or "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in ROLES or _HIDDEN_STYLE.search(own.get("style", "")):
                by = tag
            elif tag == "header" and not inner:
                by = "header"
            elif by_name and tag not in ("body", "html", "main"):
                by = _away(names)
                if not by and not inner and tag not in ("h1", "h2", "h3") and re.search(r"(?:^|[\s_-])header\b", names):
                    by = "header"
            if tag not in BLOCKS and not by and not whole:
                continue  # an inline tag
            if tag not in BLOCKS and tag not in DROPPED:
                # an inline tag that is not main text: left out up to its end, or without one up to the next block
                if not stack[-1].dropped:
                    inline = inline or _inline_ends(html)
                    at = inline[0].get(m.start()) or inline[1].get(m.start(), len(html))
                continue
            if not stack[-1].dropped:
                flush()
            if tag in ("p", "li", "tr", "td", "dt", "dd") or tag in BLOCKS and stack[-1].tag == "p":
                while stack[-1].tag == "p" or stack[-1].tag == tag and tag != "div":
                    leave()
            if stack[-1].dropped and not by and tag in ("article", "main") and not stack[-1].comments:
                while stack[-1].dropped:  # an end tag is missing above
                    leave()
            top = stack[-1]
            container = top.container
            if tag in CONTAINERS and not (by or top.dropped):
                first = (own.get("class") or own.get("id") or "").replace(">", " ").split()
                container = self._add(tag, f"{tag}.{_DIGITS.sub('#', '.'.join(sorted(first)))}" if first else tag, top.container)
            words = {w.lower() for w in _NAME_PARTS.findall(names)}
            content = bool(CONTENT & words) and not (LAYOUT | AROUND | {"wrapper", "container"}) & words
            opened[tag] = opened.get(tag, 0) + 1
            if by != "form":
                form = top.form if by is None else None
            stack.append(_Open(tag, top.dropped or by is not None, container, top.inner or tag in WHOLE or content, top.comments or by in COMMENTS, form))
        if at < len(html) and not stack[-1].dropped:
            parts.append(html[at:])
        flush()

    def scores(self) -> list[float]:
        """A container's score: its characters outside links, those of nested containers counted by nine tenths each level up."""
        own = [0.0] * len(self.paths)
        for container, text, free in self.blocks:
            own[container] += free - 0.5 * (len(text) - free)
        for k in range(len(own) - 1, 0, -1):
            own[self.parents[k]] += 0.9 * max(0.0, own[k])
        return own

    def sums(self) -> tuple[list[int], list[int]]:
        """Each container's characters, and those outside links, with all inside it."""
        total, free = [0] * len(self.paths), [0] * len(self.paths)
        for container, text, outside in self.blocks:
            total[container] += len(text)
            free[container] += outside
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
            free[self.parents[k]] += free[k]
        return total, free

    def pick(self, scores: list[float]) -> int:
        """The best container, or the outermost around it that adds text which isn't mostly links; none around an article
        or main but another of these. -1 if no container has a score."""
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        if scores[best] <= 0:
            return -1
        total, free = self.sums()
        whole = self.tags[best] in WHOLE
        k = self.parents[best]
        while k >= 0:
            if not whole or self.tags[k] in WHOLE:
                added = total[k] - total[best]
                if added and 2 * (free[k] - free[best]) >= added:
                    best = k
            whole = whole or self.tags[k] in WHOLE
            k = self.parents[k]
        return best

    def votes(self) -> list[tuple[str, float]]:
        """The paths of the pick and of the best containers in it, with shares of the page's vote."""
        scores = self.scores()
        pick = self.pick(scores)
        if pick >= 0:
            scores[pick] = max(scores) / 0.9
            scores = [s if inside else 0.0 for s, inside in zip(scores, self.under({pick}), strict=True)]
        most = nsmallest(VOTES, ((-s, k) for k, s in enumerate(scores) if s > 0 and self.paths[k]))
        best = [(-s, self.path(self.paths[k])) for s, k in most]
        total = sum(s * s for s, _ in best)
        return [(p, s * s / total) for s, p in best]

    def under(self, chosen: set[int]) -> list[bool]:
        """Of each container, whether it is one of those chosen or inside of one."""
        under = [False] * len(self.paths)
        for k in range(len(under)):
            under[k] = k in chosen or (k > 0 and under[self.parents[k]])
        return under

    def main_text(self, winners: Sequence[str]) -> str:
        pick = self.pick(self.scores())
        own = self.under({max(pick, 0)})
        total, free = self.sums()
        for n, path in enumerate(map(self.number, winners)):
            if n and pick >= 0 and path != self.paths[pick]:
                continue
            under = self.under({k for k, p in enumerate(self.paths) if p == path and (pick < 0 or k == pick or 2 * free[k] >= total[k])})
            if any(under) and (pick < 0 or all(under[c] for c, _, _ in self.blocks if own[c])):
                if text := "\n".join(t for c, t, _ in self.blocks if under[c]):
                    return text
        return "\n".join(t for c, t, _ in self.blocks if own[c])


def read_page(html: str | None) -> Page:
    """By names first; a page that names leave without text is read without them. A form that has as much text as the rest of the page isn't
    there to be filled in but holds the page: it is read like any part."""
    page = _read_whole(html, True)
    return page if page.blocks else _read_whole(html, False)


def _read_whole(html: str | None, by_name: bool) -> Page:
    page = Page(html, by_name)
    most = max(page.in_forms, default=0)
    if most and 2 * most >= sum(free for _, _, free in page.blocks) + sum(page.in_forms):
        return Page(html, by_name, frozenset([page.in_forms.index(most)]))
    return page


def host_of(url: Column) -> Column:
    """The host of a url, lower case, without user and port; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, vote) over all pages, summed within tasks and then by Spark."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            hosts = batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 256):
                for host, h in zip(hosts[low : low + 256], batch.column(1).slice(low, 256).to_pylist(), strict=True):
                    for path, share in read_page(h).votes():
                        sums[host, path] = sums.get((host, path), 0.0) + round(share * 1_000_000)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array([int(v) for v in sums.values()], pa.int64())], ["host", "path", "vote"])

    return pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(vote, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("vote"))


def winning_paths(votes: DataFrame, most: int = WINNERS) -> DataFrame:
    """(host, paths): the host's paths of most votes, best first."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("vote"), "path"))
    top = votes.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """The columns ``keep``, text and n_chars (its code points) of every page."""
    winners = materialize(winning_paths(path_votes(pages, url, html)), "host-paths")
    with_host = pages.select(*keep, host_of(F.col(url)).alias("_host"), F.col(html).alias("_html"))
    joined = with_host.join(winners.withColumnRenamed("host", "_host"), "_host", "left").select(*keep, "_html", "paths")
    fields = joined.schema.fields[: len(keep)]
    out = StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        n = len(fields)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                htmls, paths = part.column(n).to_pylist(), part.column(n + 1).to_pylist()
                for i, j in slices(htmls):
                    texts = [read_page(h).main_text(p or ()) for h, p in zip(htmls[i:j], paths[i:j], strict=True)]
                    kept = [part.column(k).slice(i, j - i).cast(arrow.field(k).type) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return joined.mapInArrow(read, out)

