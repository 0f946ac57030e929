"""Main text of web pages by equivalence classes of the tokens that pages of a host share.

A page is read as tokens in order: opening tags and text strings, each with its
path of elements (tag, class, id) from the root.  ``token + path`` is a role.

1. For every host and role Spark sums the occurrence vector over the pages of
   the host as a fingerprint (each page gives a hash of its own content and of
   the number of times the role occurs there), with the number of pages and
   the place in a reference page of the host.
2. Roles of one host with one vector that occur on every page form an
   equivalence class, in the order of the reference page.  A class is used if
   it has ``LEAST_CLASS`` roles and the host ``LEAST_PAGES`` different
   longest strings (so copies of one article are no template of each other).
3. In a page a class is valid if its roles come there in the order of the
   class, as often as they come at all, and if its rounds nest in the gaps of
   the other classes.  The text strings of valid classes are template, all
   other strings are slots.
4. Slots are extracted in page order where they stand in the article: inside
   ``article`` elements, else ``main``; else inside the element path in which
   the pages of the host have most of their slot text; and not inside menus,
   headers, footers, sidebars, notices, adverts, forms, comments, scripts or
   styles, told by element, role, class or id.

White space (as in ``str.split``) inside a block becomes one space, blocks are
joined by two line feeds; ``br`` is white space.

The table of classes and paths has some rows a host.  It is broadcast where a
count proves it small; else it meets the pages by a join, dealt over ``SALTS``
parts of each host.

Defined cases: null and empty html give the empty text; a null or unreadable
url is the host ``""``; broken markup is read as far as it goes (elements left
open end with their parent; an article inside something left out is the
article only where the page has no other); one page of a host has no template and is read by its elements
alone; repeated rows give equal rows; an empty table gives an empty result;
other columns are carried and columns named like a result are replaced.  Time
is near linear in the length of a page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import has_at_most
from .common import shared, small_batches, table

LEAST_CLASS, LEAST_PAGES = 3, 5
#: share of a page's slot text that the main element path holds at least
MAIN_SHARE = 0.6
#: rows of the table of classes up to which it is broadcast, and roles in them
BROADCAST_ROWS, BROADCAST_ROLES = 20_000, 1_000_000
SALTS = 32

#: elements by their use (fixed values of the markup language)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
                   "sup time tt u var wbr br img".split())
NEVER = frozenset("head script style noscript template textarea title iframe svg math canvas object audio video select option button form "
                  "fieldset input datalist dialog nav footer aside menu noembed noframes xmp".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())
#: parts of class and id names that mark what is no article, and comments among them
MARKS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay "
                  "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social "
                  "footer masthead pagination pager login signup newsletter subscribe subscription cookie cookies consent gdpr notice "
                  "alert toolbar copyright paywall hidden".split())
COMMENTS = frozenset("comment comments disqus respond replies discussion".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: a name with one of these says what its element does about another one
ABOUT = frozenset("with has no without is".split())

_TOKEN = re.compile(r"""<(?:!--|([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|/([a-zA-Z][^\s/<>]*+)[^<>]*+>|[!?/][^>]*+>)""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s"'/]|$)""", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: states of an element: kept, left out, left out for good (comments and what is no text)
KEPT, OUT, GONE = 0, 1, 2


def digest(*parts) -> int:
    """A 64-bit name, alike on all workers."""
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Element:
    __slots__ = ("tag", "path", "state", "article", "main", "link", "paths")

    def __init__(self, tag, path, state, article, main, link, paths):
        self.tag, self.path, self.state, self.article, self.main, self.link, self.paths = tag, path, state, article, main, link, paths


class Text:
    """One text string: its role, block, state and surroundings."""
    __slots__ = ("role", "text", "block", "state", "article", "main", "link", "paths")

    def __init__(self, role, text, block, e: Element):
        self.role, self.text, self.block = role, text, block
        self.state, self.article, self.main, self.link, self.paths = e.state, e.article, e.main, e.link, e.paths


def _marks(attributes: str) -> tuple[str, bool, bool, str]:
    """(class and id, marked as no article, marked as comments, role) of an element."""
    names, out, comments, role = [], False, False, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out = True
        elif name == "style":
            out |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            role = value.lower().strip()
        elif name in ("class", "id"):
            for one in value.split():
                names.append(name[0] + one)
                parts = {p.lower() for p in _WORDS.findall(one)}
                if not parts & ABOUT:
                    out |= bool(parts & MARKS)
                    comments |= bool(parts & COMMENTS)
    return " ".join(names), out, comments, role


class Page:
    """The tokens of a page: ``roles`` of opening tags and texts in order, and the ``texts``."""

    _names: dict = {}

    def __init__(self, html: str):
        self.roles: list[int] = []
        self.texts: list[Text] = []
        self._stack = [Element("", 0, KEPT, 0, False, False, (0,))]
        self._block = 0
        at, n = 0, len(html)
        while at < n:
            found = _TOKEN.search(html, at)
            if found is None:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at:found.start()])
            at = found.end()
            opened, attributes, closed = found.groups()
            if opened is not None:
                tag = opened.lower()
                self._open(tag, attributes)
                if tag in RAW:  # its content is no text of the page
                    end = _CLOSE[tag].search(html, at)
                    at = end.start() if end else n
            elif closed is not None:
                self._close(closed.lower())
            elif found.group() == "<!--":
                end = html.find("-->", at)
                at = n if end < 0 else end + 3

    def _name(self, *parts) -> int:
        names = Page._names
        if parts not in names:
            if len(names) > 200_000:
                names.clear()
            names[parts] = digest(*parts)
        return names[parts]

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag not in INLINE:
            self._block += 1
            self._end_paragraph()
            ends = ENDS.get(tag)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in LISTS:
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
        up = stack[-1]
        names, out, comments, role = _marks(attributes) if attributes else ("", False, False, "")
        path = self._name(up.path, tag, names)
        self.roles.append(path)
        if tag == "br":
            self.texts.append(Text(0, "\n", self._block, up))
        if tag in VOID:
            return
        body = tag in ("html", "body", "main")
        article = tag == "article" or role == "article"
        main = tag == "main" or role == "main"
        state = up.state
        if comments and not body:
            state = GONE
        elif out and not body:
            state = max(state, OUT)
        elif article or main:  # a menu or advert before it may have been left open
            state = KEPT if state == OUT else state
        elif tag in NEVER:
            state = GONE if tag not in ("nav", "form", "noscript", "dialog", "menu", "head") else max(state, OUT)
        elif role in ROLES or (tag == "header" and not (up.article or up.main)):
            state = max(state, OUT)
        paths = up.paths if tag in INLINE or tag == "p" else (*up.paths, path)
        # an article that stands in something left out counts only where the page has no other
        rank = up.article or (2 if up.state == KEPT else 1 if state == KEPT else 0) * article
        stack.append(Element(tag, path, state, rank, up.main or main, up.link or tag == "a", paths))

    def _end_paragraph(self) -> None:
        """Blocks end an open paragraph of the same parent."""
        stack = self._stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                return
            if stack[i].tag not in INLINE:
                return

    def _close(self, tag: str) -> None:
        stack = self._stack
        inline = tag in INLINE
        if not inline:
            self._block += 1
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if inline and stack[i].tag not in INLINE:
                return
            if stack[i].tag in ("article", "main") and tag not in ("body", "html", "main", "article"):
                return  # a stray end tag does not end the article

    def _text(self, raw: str) -> None:
        e = self._stack[-1]
        if e.tag in RAW:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        shown = " ".join(text.split())
        role = digest(e.path, shown) if shown else 0
        if shown:
            self.roles.append(role)
        self.texts.append(Text(role, text, self._block, e))

    def scope(self, main_path: int | None = None):
        """Which texts stand in the article, by elements or by the host's main path."""
        kept = [t for t in self.texts if t.state == KEPT]
        for inside in (lambda t: t.article == 2, lambda t: t.article, lambda t: t.main, lambda t: main_path is not None and main_path in t.paths):
            if any(inside(t) and t.text.strip() for t in kept):
                return [t for t in kept if inside(t)]
        return kept

    def article(self, template: set, main_path: int | None = None) -> str:
        """The extracted text."""
        blocks: dict[int, list[str]] = {}
        for t in self.scope(main_path):
            if t.role not in template:
                blocks.setdefault(t.block, []).append(t.text)
        shown = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(s for s in shown if s)

    def template(self, classes: list[list[int]]) -> set:
        """The roles of the classes that are valid in this page: ordered, and nested in each other."""
        places: dict[int, list[int]] = {}
        member = {role: c for c, roles in enumerate(classes) for role in roles}
        order: list[list[int]] = [[] for _ in classes]
        for i, role in enumerate(self.roles):
            if role in member:
                places.setdefault(member[role], []).append(i)
                order[member[role]].append(role)
        valid = [c for c, roles in enumerate(classes) if order[c] and len(order[c]) % len(roles) == 0
                 and order[c] == roles * (len(order[c]) // len(roles))]
        valid.sort(key=lambda c: len(order[c]) // len(classes[c]))
        nested: list[int] = []
        for c in valid:
            own, size = places[c], len(classes[c])
            rounds = [(own[i], own[i + size - 1]) for i in range(0, len(own), size)]
            # every round lies in one gap of a class with fewer rounds; classes with as many may alternate with it
            if all(len(places[o]) // len(classes[o]) == len(rounds)
                   or all(bisect_left(places[o], a) == bisect_left(places[o], b) for a, b in rounds) for o in nested):
                nested.append(c)
        return {role for c in nested for role in classes[c]}


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


TAG, TEXT, LONGEST, PATH = range(4)
COUNTS = ("host string, kind int, role long, low long, high long, pages long, reference long, place long, size long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def count_roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors of the roles in a batch of (url, html): one row a host and role."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page, host, html = Page(html or ""), host_of(url), html or ""
            own = digest(html)
            times: dict[tuple, list[int]] = {}
            texts = {t.role for t in page.texts}
            for i, role in enumerate(page.roles):
                times.setdefault((TEXT if role in texts else TAG, role), [0, i])[0] += 1
            scope = page.scope()
            longest = max((t for t in scope if t.role), key=lambda t: len(t.text), default=None)
            times[LONGEST, longest.role if longest else 0] = [1, 0]
            sizes: dict[int, int] = {}
            if not any(t.article or t.main for t in scope):
                for t in scope:
                    if t.role and not t.link:
                        for path in t.paths:
                            sizes[path] = sizes.get(path, 0) + len(t.text)
            depth = {path: i for t in scope for i, path in enumerate(t.paths)}
            for path, size in sizes.items():
                times[PATH, path] = [size, depth[path]]
            for (kind, role), (n, place) in times.items():
                vector = digest(own, n) if kind in (TAG, TEXT) else 0
                row = (vector & 0xFFFFFFFF, vector >> 32, 1, own >> 1, place, n if kind == PATH else 0)
                old = found.get((host, kind, role))
                if old is not None:
                    first = min(old[3:5], row[3:5])
                    row = (old[0] + row[0], old[1] + row[1], old[2] + 1, *first, old[5] + row[5])
                found[host, kind, role] = row
        rows = [(*key[:2], _signed(key[2]), *row) for key, row in found.items()]
        columns = list(zip(*rows)) or [()] * 9
        types = [pa.string(), pa.int32()] + [pa.int64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=[c.split()[0] for c in COUNTS.split(", ")])


def learn_templates(pages: DataFrame) -> DataFrame:
    """(host, classes, main_path) of the hosts that have one: classes of roles, each in its order."""
    small_batches(pages.sparkSession)
    counted = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(count_roles, COUNTS)
    roles = shared(counted.groupBy("host", "kind", "role").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("pages").alias("pages"),
        F.min(F.struct("reference", "place")).alias("first"), F.sum("size").alias("size")), "html-roles")
    hosts = roles.where(F.col("kind") == LONGEST).groupBy("host").agg(F.sum("pages").alias("all"), F.count("*").alias("contents"))
    classes = (roles.where(F.col("kind") <= TEXT).join(hosts.where(F.col("contents") >= LEAST_PAGES), "host")
               .where(F.col("pages") == F.col("all"))
               .groupBy("host", "low", "high").agg(
                   F.sort_array(F.collect_list(F.struct("first.place", "role"))).alias("members"),
                   F.max("kind").alias("kind"))
               .where((F.size("members") >= LEAST_CLASS) & (F.col("kind") == TEXT))
               .groupBy("host").agg(F.sort_array(F.collect_list("members.role")).alias("classes")))
    paths = roles.where(F.col("kind") == PATH)
    most = paths.groupBy("host").agg(F.max("size").alias("most"))
    main = (paths.join(most, "host").where(F.col("size") >= MAIN_SHARE * F.col("most"))
            .groupBy("host").agg(F.max_by("role", F.struct(F.col("first.place"), "size", "role")).alias("main_path")))
    return classes.join(main, "host", "full")


TEXTS = T.StructType([T.StructField("article", T.StringType())])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``article``, the main text of html."""
    learned = shared(learn_templates(pages), "html-templates")
    kept = [f for f in pages.schema.fields if f.name != "article"]
    rows = pages.select(F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)]).alias("r"),
                        F.col("html").cast("string").alias("html"),
                        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")),
                                                 r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"))
    roles = learned.agg(F.coalesce(F.sum(F.size(F.flatten("classes"))), F.lit(0)).alias("n")).first()["n"]
    if has_at_most(learned, BROADCAST_ROWS) and roles <= BROADCAST_ROLES:
        met = rows.join(F.broadcast(learned), "host", "left")
    else:
        salted = learned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, classes, main in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                page = Page(html or "")
                known = [[role & (1 << 64) - 1 for role in one] for one in classes or ()]
                texts.append(page.article(page.template(known) if known else set(), None if main is None else main & (1 << 64) - 1))
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "article"])

    return met.select("r", "html", "classes", "main_path").mapInArrow(work, T.StructType([*kept, *TEXTS.fields]))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("article").alias("text"), F.length("article").cast("long").alias("n_chars"))
