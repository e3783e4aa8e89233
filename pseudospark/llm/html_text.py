"""Main text of web pages by consensus of a host's pages.

Every page scores its containers by the text of their own: letters, links, sentence ends, kinds of blocks, and whether an
article or main element holds them. The scores, weighed by the share of the page's letters, are votes on the container's
path (tags and classes without numbers). Spark adds up the votes of each host, and with them how often a path holds the
same text. Paths with votes above zero win, and every page is extracted again from its containers on winning paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudospark.llm.words import text_column
from pseudospark.sources.files import Workspace

#: The share of a page's text that is enough for the containers marked as main ones.
MARKED = 0.3
#: Different pages that must hold the same text in a path before it is no article.
REPEATED = 3
#: A container that holds more than this share of a page is not taken for repeated.
MOST = 0.5
#: Votes are whole numbers, so that their sums do not depend on the order; a page of one container casts this many.
VOTES = 1_000_000
#: Verdicts on paths of one host, counted in bytes, that are broadcast; beyond that they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Parts into which the pages of a host are split where the join shuffles.
PARTS_OF_HOST = 64

# Fixed values of HTML: element kinds, and names by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video map select textarea button title head".split())
CONTAINERS = frozenset("body main article section div td center table tbody tr ul ol dl".split())
BLOCKS = CONTAINERS | frozenset(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre header footer nav aside form fieldset figure figcaption "
    "address details summary hr thead tfoot th caption".split()
)
DROPPED = RAW | frozenset("nav header footer aside form fieldset dialog menu label input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner "
    "sidebar sidebars aside widget widgets nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar "
    "footer foot colophon comment comments commentlist disqus discussion replies reply respond cookie cookies consent "
    "notice notices notification notifications alert gdpr popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations trending pagination pager skip copyright disclaimer".split()
)
#: Those of them that name readers' comments.
READER_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that add nothing to the others in a name.
FILLERS = frozenset(
    "user users reader readers site page post posts article articles story stories box area list wrap wrapper container "
    "block section thread form body bar content links inner outer top bottom left right main global inline".split()
)
#: Names that parts of articles have as well: they need a further sign.
AMBIGUOUS = frozenset("header masthead banner topbar discussion disclaimer copyright alert colophon foot footer login skip reply".split())
#: Words that name the part of an article together with these pieces, as article-header.
PART_OF = (frozenset(["header", "masthead", "banner"]), frozenset("article post entry story content section chapter".split()))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names tell of a part of the page; others, as paragraphs and spans, need a further sign.
PARTS = frozenset("div section ul ol dl table tbody tr td details figure".split())
#: A part that has such a name counts as no text if this share of its letters is linked.
LINKED = 0.5
FORMS = frozenset(["form", "fieldset"])
#: A form or an element with an ambiguous name that holds more than this share of a page's text is the page.
WHOLE = 0.5
#: Blocks of running text.
PROSE = HEADINGS | frozenset("p pre blockquote li dd".split())
#: What names say of an element.
PLAIN, LOOSE, SURE, READERS = range(4)
#: Which open element a start tag ends, if it comes before one of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?"
    # Nothing inside these is markup, up to the element's own end.
    r"|<(?i:(script|style|textarea|title|noscript|iframe|svg|template))(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?i:\1)\s*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"']+)""")
_NAME_PART = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f](?=\s|$)|[\u3002\uff01\uff1f]")
_TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


_PARAGRAPH = frozenset(["p"])
_PARAGRAPH_SCOPE = frozenset("td th table button div article section main body blockquote li".split())


@lru_cache(maxsize=20_000)
def _described(tag: str, attributes: str) -> tuple[str, bool, bool, int]:
    """Path step of an element, whether its tag, role or style drops it, whether it is the main part, and its names."""
    step, dropped, marked = tag, tag in DROPPED, tag in ("article", "main")
    if not _TELLING.search(attributes):
        return step, dropped, marked, PLAIN
    values = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = values.get("role", "").lower()
    marked = marked or role == "main"
    dropped = dropped or role in DROPPED_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true"
    dropped = dropped or "display:none" in values.get("style", "").replace(" ", "").lower()
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in values.get("class", "").lower().split()})
    if tag in ("body", "html"):
        classes = []  # they name the page, not a place on it
    names = PLAIN
    if tag not in ("body", "html", "main") and role != "main":
        names = _names(tag, values.get("class", ""), values.get("id", ""))
    return ".".join([tag, *classes]), dropped, marked, names


def _names(tag: str, classes: str, id: str) -> int:
    """What class and id names say. Ids of headings and sections are made of the words of headings."""
    said = PLAIN
    listed = [(name, False) for name in _CAMEL.sub("-", classes).lower().split()]
    if tag not in HEADINGS:
        listed += [(name, tag == "section") for name in _CAMEL.sub("-", id).lower().split()]
    for name, of_heading in listed:
        found = set(_NAME_PART.findall(name))
        telling = found & DROPPED_NAMES
        if not telling:
            continue
        alone = found <= DROPPED_NAMES | FILLERS
        if alone and found & READER_NAMES and (tag in PARTS or tag == "article"):
            return READERS
        if tag == "article" or of_heading or (telling <= PART_OF[0] and found & PART_OF[1]):
            continue
        said = max(said, SURE if alone and not telling <= AMBIGUOUS else LOOSE)
    return said


class Page:
    """Elements of a page as a tree, in document order, with their text. Unclosed and stray tags are made the best of."""

    def __init__(self, html: str):
        self.parent = [-1]
        self.tag = [""]
        self.step = [""]
        self.dropped = [False]
        self.marked = [False]
        self.names = [PLAIN]
        self.holds_main = [False]
        #: (element, text, elements opened before), in order; None stands for white space, as of a line break.
        self.text: list[tuple[int, str | None, int]] = []
        self._read(html)

    def _open(self, stack: list[int], tag: str, attributes: str) -> int:
        step, dropped, marked, names = _described(tag, attributes)
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.step.append(step)
        self.dropped.append(dropped)
        # What lies among readers' comments is not the main part.
        marked = marked and names != READERS and not any(self.names[above] == READERS for above in stack)
        self.marked.append(marked)
        self.names.append(names)
        self.holds_main.append(False)
        if marked:
            # What holds the main part is not to be dropped for its name.
            for above in stack:
                self.holds_main[above] = True
                if self.tag[above] not in DROPPED or self.tag[above] in FORMS:
                    self.dropped[above] = False
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack = [0]
        text, tags, add = self.text, self.tag, self.text.append
        at = 0
        for found in _MARKUP.finditer(html):
            start, end = found.span()
            if start > at:
                add((stack[-1], html[at:start], len(tags) - 1))
            at = end
            tag = found[3]
            if tag is None:
                continue
            tag = tag.lower()
            if found[2]:
                if tags[stack[-1]] == tag:
                    stack.pop()
                    continue
                place = next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] == tag), 0)
                if place:
                    del stack[place:]
                elif tag == "p" or tag == "br":
                    add((stack[-1], None, len(tags) - 1))
                continue
            if tag in VOID:
                if tag == "br":
                    add((stack[-1], None, len(tags) - 1))
                elif tag in BLOCKS:
                    add((self._open(stack, tag, ""), None, len(tags) - 1))
                continue
            if tag == "body" and "body" in (tags[i] for i in stack):
                continue
            if tag in _ENDS_PARAGRAPH:
                self._close(stack, _PARAGRAPH, _PARAGRAPH_SCOPE)
            if tag in CLOSES:
                self._close(stack, *CLOSES[tag])
            number = self._open(stack, tag, found[4])
            if tag in BLOCKS or not found[4].endswith("/"):
                stack.append(number)
        if at < len(html):
            add((stack[-1], html[at:], len(tags) - 1))

    def _close(self, stack: list[int], tags: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in tags:
                del stack[i:]
                return
            if tag in scope:
                return

    def finish(self) -> None:
        """Carry what is dropped down the tree; paths and sizes of containers."""
        n = len(self.tag)
        self._judge()
        self.block, self.container, self.path = [0] * n, [0] * n, [""] * n
        self.linked = linked = [False] * n
        for i in range(1, n):
            above = self.parent[i]
            self.dropped[i] = self.dropped[i] or self.dropped[above]
            linked[i] = linked[above] or self.tag[i] == "a"
            self.block[i] = i if self.tag[i] in BLOCKS else self.block[above]
            own = self.tag[i] in CONTAINERS
            self.container[i] = i if own else self.container[above]
            self.path[i] = (f"{self.path[above]}>{self.step[i]}" if self.path[above] else self.step[i]) if own else self.path[above]

    def _judge(self) -> None:
        """Drop what names and forms say is no text, as far as where it lies and what it holds agree."""
        n = len(self.tag)
        forms = [i for i in range(1, n) if self.tag[i] in FORMS and self.dropped[i]]
        named = [i for i in range(1, n) if self.names[i] and not self.dropped[i] and not self.holds_main[i]]
        if not forms and not named:
            return
        tag, parent, dropped = self.tag, self.parent, self.dropped
        article = [t == "article" and m for t, m in zip(tag, self.marked)]
        holds = list(article)
        for i in range(n - 1, 0, -1):
            holds[parent[i]] = holds[parent[i]] or holds[i]
        # A main element that holds an article is no more than the page around it.
        inside = [a or (m and not h) for a, m, h in zip(article, self.marked, holds)]
        out, linked = [False] * n, [False] * n
        for i in range(1, n):
            above = parent[i]
            inside[i] = inside[i] or inside[above]
            out[i] = out[above] or (dropped[i] and tag[i] not in FORMS)
            linked[i] = linked[above] or tag[i] == "a"

        def letters(skipped: list[bool]) -> tuple[list[int], list[int]]:
            """Letters below each element, and those of them in links."""
            every, links = [0] * n, [0] * n
            for i, text, _ in self.text:
                if text is not None and not skipped[i]:
                    size = len(text) - text.count(" ") - text.count("\n")
                    every[i] += size
                    if linked[i]:
                        links[i] += size
            for i in range(n - 1, 0, -1):
                every[parent[i]] += every[i]
                links[parent[i]] += links[i]
            return every, links

        every, links = letters(out)
        total = every[0] - links[0]
        loose = []
        for i in named:
            if self.names[i] >= SURE:
                # Names of the whole page are none of a part.
                dropped[i] = every[i] < every[0]
            elif links[i] and links[i] >= LINKED * every[i]:
                dropped[i] = every[i] < every[0]
            elif tag[i] in PARTS and not inside[i] and every[i] - links[i] <= WHOLE * total:
                dropped[i] = True
                loose.append(i)
        for i in range(1, n):
            out[i] = out[parent[i]] or (dropped[i] and tag[i] not in FORMS)
        if loose and every[0] and not letters(out)[0][0]:
            for i in loose:
                dropped[i] = False
        if forms:
            out = [False] * n
            for i in range(1, n):
                out[i] = out[parent[i]] or (dropped[i] and tag[i] not in FORMS)
            every, links = letters(out)
            total = every[0] - links[0]
            for i in forms:
                if every[i] - links[i] > WHOLE * total:
                    dropped[i] = False

    def scored(self) -> dict[str, tuple[float, float, str | None]]:
        """Score, share of the page's letters and text of the containers on each path, by the text of their own.

        The text is None where it may not be taken for one that the host repeats.
        """
        n = len(self.tag)
        within = [False] * n
        for i in range(1, n):
            within[i] = within[self.parent[i]] or (self.marked[i] and not self.dropped[i])
        plain: dict[str, int] = {}
        links: dict[str, int] = {}
        texts: dict[str, list[str]] = {}
        prose: set[str] = set()
        marked: set[str] = set()
        in_marked = 0
        for i, text, _ in self.text:
            if text is None or self.dropped[i]:
                continue
            path = self.path[i]
            size = len(text) - text.count(" ") - text.count("\n")
            if not size:
                continue
            of = links if self.linked[i] else plain
            of[path] = of.get(path, 0) + size
            texts.setdefault(path, []).append(text)
            if self.tag[self.block[i]] in PROSE:
                prose.add(path)
            if within[i]:
                marked.add(path)
                if of is plain:
                    in_marked += size
        total = sum(plain.values()) + sum(links.values())
        told = bool(marked) and in_marked > 0 and in_marked >= MARKED * sum(plain.values())
        found = {}
        for path, parts in texts.items():
            letters, linked = plain.get(path, 0), links.get(path, 0)
            text = " ".join(" ".join(parts).split())
            share = (letters + linked) / total
            if told:
                score = 1.0 if path in marked else -1.0
            else:
                score = 0.6 * min(1.0, letters / 120) - 1.6 * linked / (letters + linked)
                score += 0.4 * bool(_SENTENCE_END.search(text)) + 0.3 * (path in prose)
            found[path] = score, share, None if told or share > MOST else text
        return found

    def extract(self, verdicts: dict[str, bool] | None = None) -> str:
        """Text of the containers on winning paths. Where no verdict of the host is given the page's own score decides;
        if none of its paths wins, first these scores alone, and then all that is not dropped, make the text."""
        own = {path: score > 0 for path, (score, _, _) in self.scored().items()}
        wins = {**own, **{path: won for path, won in (verdicts or {}).items() if path in own}}
        if not any(wins.values()):
            wins = own if any(own.values()) else dict.fromkeys(own, True)
        blocks: list[str] = []
        parts: list[str] = []
        current = -1
        before = 0
        for i, text, opened in self.text:
            if self.dropped[i] or not wins.get(self.path[i], True):
                continue
            # A block that was opened between two parts of a text ends the first one.
            if parts and (self.block[i] != current or any(self.block[k] == k for k in range(before + 1, opened + 1))):
                blocks.append("".join(parts))
                parts = []
            current, before = self.block[i], opened
            parts.append(" " if text is None else unescape(text))
        if parts:
            blocks.append("".join(parts))
        return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def read_page(html: str) -> Page:
    page = Page(html)
    page.finish()
    return page


def host(url: Column) -> Column:
    """Host of a URL, in lower case; empty if there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def _htmls(batch: pa.RecordBatch) -> Iterator[str]:
    data, offsets = text_column(batch, "text")
    for k in range(len(batch)):
        yield str(data[offsets[k] : offsets[k + 1]], "utf-8", "replace")


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        rows = []
        hosts = batch.column(0).to_pylist()
        for name, html in zip(hosts, _htmls(batch)):
            page = _digest(html)
            for path, (score, share, text) in read_page(html).scored().items():
                vote = max(1, round(VOTES * score * share)) if score > 0 else round(VOTES * score * share)
                rows.append((name, path, None if text is None else _digest(text), page, vote))
        columns = zip(*rows) if rows else ((),) * len(types)
        names = ["host", "path", "text", "page", "vote"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdicts = batch.column(batch.schema.get_field_index("verdicts")).to_pylist()
        texts = []
        for html, told in zip(_htmls(batch), verdicts):
            texts.append(read_page(html).extract({v["path"]: v["won"] for v in told or ()}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def path_votes(source: DataFrame) -> DataFrame:
    """``host, path, votes, won, overruled`` from pages with ``host`` and ``text``.

    A path wins by votes above zero, unless most of the pages that have it hold the same text there. ``overruled`` tells
    whether some page's own score says otherwise. Copies of a page vote once: what only they repeat may be an article.
    """
    votes = source.select("host", "text").mapInArrow(_vote, "host string, path string, text long, page long, vote long")
    alike = votes.distinct().groupBy("host", "path", "text")
    alike = alike.agg(
        F.count(F.lit(1)).alias("pages"), F.sum("vote").alias("votes"), F.min("vote").alias("low"), F.max("vote").alias("high")
    )
    told = alike.groupBy("host", "path").agg(
        F.max(F.when(F.col("text").isNotNull(), F.col("pages"))).alias("equal"),
        F.sum("pages").alias("all"),
        F.sum("votes").alias("votes"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    repeated = (F.coalesce("equal", F.lit(0)) >= REPEATED) & (2 * F.coalesce("equal", F.lit(0)) > F.col("all"))
    won = (F.col("votes") > 0) & ~repeated
    overruled = F.when(won, F.col("low") <= 0).otherwise(F.col("high") > 0)
    return told.select("host", "path", "votes", won.alias("won"), overruled.alias("overruled"))


def main_texts(
    pages: DataFrame, workspace: Workspace, *, id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``: the article, from the whole HTML.

    Character references are decoded, white space inside a block is one space, blocks are joined by one space in page
    order. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and readers' comments get no
    score: elements, roles and class or id names tell them, though a name drops nothing that is the whole page, and an
    ambiguous one nothing that holds most of it. All else is taken or left by the votes of the page's host. Pages
    without host form one host. A null HTML is empty; an empty or textless page has an empty text. Repeated rows are
    extracted each by itself; ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    source = pages.select(
        F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("text")
    ).withColumn("host", host(F.col("url")))
    # Only verdicts that overrule some page travel: pages come to the others by themselves.
    told = path_votes(source).where("overruled").groupBy("host")
    told = workspace.save(told.agg(F.collect_list(F.struct("path", "won")).alias("verdicts")), "verdicts")
    size = F.sum(F.length("host") + F.aggregate("verdicts", F.lit(0), lambda n, v: n + F.length(v["path"]) + 16))
    if (told.agg(size).first()[0] or 0) <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(told), "host", "left")
    else:
        part = F.pmod(F.xxhash64("text", "url"), F.lit(PARTS_OF_HOST))
        copies = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS_OF_HOST - 1))).cast("long"))
        joined = source.withColumn("part", part).join(copies, ["host", "part"], "left")
    types = f"page_id {pages.schema[id].dataType.simpleString()}, url string, text string"
    return (
        joined.select("page_id", "url", "text", "verdicts")
        .mapInArrow(_extract, types)
        .withColumn("n_chars", F.length("text").cast("long"))
    )
