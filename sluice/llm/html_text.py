"""HTML extraction by template deduction over the pages of a host.

Tokens are elements under their path from the root (tag, id and class), and the
words that stand directly in them. Two tokens of a host are equivalent if their
occurrence vectors agree: they stand equally often in each page. Vectors are
never gathered; an element's vector is summed up in a few numbers (pages,
occurrences, sum of hashes of page and count), and its words are of its class if
the least and the largest hash of them over the pages agree. Partial aggregation
combines both, so a host of any size costs one row a path and task. A class is
valid if it is frequent and has several tokens; elements of valid classes, and
those that stand directly in one, make the host's template as far as all that
they hang below is in it. Words of a valid class are template text; all other
text fills slots. The article's slots are the template's elements with that
role or, without any, the lowest one that holds all text that fills slots. Within
an article's slot, template text goes too if it stands in an element with a name
of its own (a teaser that every page repeats); without one it is the article's
(a list that is the same on all pages). Lists of names only tell what a host's
pages cannot: what a page on its own, or a slot, holds besides main text.

Defined results: a null or empty html has an empty text; a null url is the host
""; a page that lacks its host's article slots is read outside of all elements
that are never main text; unclosed elements end with their parent, comments,
scripts and styles at their end mark or the page's; repeated rows each get a
row. A page whose slots hold template text alone keeps it. Time and memory grow
with a page's length, however deep its elements nest; so do those of a host with
its paths.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, table, written

#: A class is frequent if it stands in so large a part of its host's pages, and large with so many tokens.
MIN_SUPPORT = 0.5
MIN_TOKENS = 2
#: Pages that words must stand in to be known as fixed.
MIN_PAGES = 3
#: Rows of the template table that may be broadcast; beyond them the pages are joined by a shuffle.
MAX_BROADCAST = 200_000
#: Tokens that a task holds before it passes its sums on.
HELD = 200_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+(?<=/)>"""
    r"""|<(script|style|noscript|template|textarea|title|iframe|svg|select)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[/!?a-zA-Z][^>]*+>""",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Elements that part blocks, and elements or names that hold no main text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("aside button dialog footer form head menu nav object option search".split())
_NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments commentlist replies disqus respond newsletter subscribe signup login "
    "share sharing social related recommended widget toolbar pagination pager search complementary contentinfo".split()
)
#: As above, but an article's own header holds its title.
_PAGE_ONLY = frozenset({"header", "masthead"})
#: Words that may stand beside those in a name of the same element: "comment-list", "site-footer". Others ("has-sidebar", "comments-open") tell of something else.
_BESIDE = frozenset("area bar block bottom box container inner item items left list links main page post posts primary right secondary section site top wrap wrapper".split())
#: No name makes these boilerplate.
_OWN = frozenset({"html", "body", "article", "main"})
#: Boilerplate unless most of the page's main text stands in it; as are all elements with such a name.
_MAY_WRAP = frozenset({"form", "dialog", "object", "header"})
_ARTICLE = frozenset({"article", "main"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the others.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPE = frozenset({"ul", "ol", "dl", "table", "select", "html", "body", "article", "main"})


def host_of(url: Column) -> Column:
    """The host of a URL, A-Z lower-cased; "" where there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _names(attributes: str) -> tuple[str, set[str], bool]:
    """The name under which an element stands in its path, what its id, class or role say that it is, and whether its role is main."""
    if "=" not in attributes:
        return "", set(), False
    found = [(key.lower(), token) for key, value in _NAME.findall(attributes) for token in value.strip("\"'").split()]
    is_name = set()
    for _, token in found:
        parts = _PART.findall(_HUMP.sub("-", token).lower())
        if all(p in _NEVER_NAMES or p in _PAGE_ONLY or p in _BESIDE for p in parts):
            is_name.update(parts)
    return ".".join(sorted({p for _, token in found for p in _PART.findall(token.lower())})), is_name, ("role", "main") in found


class _Element:
    """own: the names or tag that may make it boilerplate; sure: nothing within can spare it."""

    __slots__ = ("tag", "path", "up", "own", "sure", "article", "is_article", "never", "chars", "main", "named")

    def __init__(self, tag: str, path: int, up: _Element | None, own: bool, sure: bool, is_article: bool) -> None:
        self.tag, self.path, self.up, self.own, self.sure, self.is_article = tag, path, up, own, sure, is_article
        self.article = is_article or up is not None and up.article
        self.never, self.chars, self.main, self.named = False, 0, 0, False


def _hash(parent: int, tag: str, name: str) -> int:
    return xxhash.xxh64_intdigest(b"%d %s %s" % (parent, tag.encode(), name.encode())) >> 1


def parse(page: str | None) -> tuple[list[_Element], list[tuple[_Element, str]]]:
    """The elements in order, from the root, and the blocks of text in order with the element that each stands in."""
    page = page or ""
    root = _Element("", 0, None, False, False, False)
    elements, blocks = [root], []
    stack, held, at = [root], [], 0
    # Where in the stack the open elements of each tag stand.
    places: dict[str, list[int]] = {}
    # No tag ends behind the last of these, so that no search for an end runs through the page in vain.
    stop = page.rfind(">") + 1

    def close(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def block() -> None:
        text = " ".join(html_lib.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append((stack[-1], text))

    for m in _TAG.finditer(page, 0, stop):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
        if tag in _VOID and tag != "hr" or tag not in _BLOCKS and tag not in _NEVER:
            continue
        if held:
            block()
        if m[2]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag == "hr":
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in _ENDS and (ended := last(_ENDS[tag])) > last(_SCOPE):
            close(ended)
        up = stack[-1]
        name, is_name, role_main = _names(m[4])
        is_article = tag in _ARTICLE or role_main
        named = tag not in _OWN and not role_main and (bool(is_name & _NEVER_NAMES) or not up.article and bool(is_name & _PAGE_ONLY))
        by_tag = tag in _NEVER or tag == "header" and not up.article
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, _hash(up.path, tag, name), up, named or by_tag, by_tag and tag not in _MAY_WRAP, is_article))
        stack[-1].named = bool(name)
        elements.append(stack[-1])
    if at < len(page):
        held.append(page[at:])
    block()
    _decide(elements, blocks)
    return elements, blocks


def _decide(elements: list[_Element], blocks: list[tuple[_Element, str]]) -> None:
    """Which elements are never main text. A name or a wrapping tag does not count for an element that holds most of the page's articles or, without any, of its text."""
    for e in elements[1:]:
        e.never = e.up.never or e.sure
    for e, text in blocks:
        if not e.never:
            e.chars += len(text)
            e.main += len(text) if e.article else 0
    for e in reversed(elements[1:]):
        e.up.chars += e.chars
        e.up.main += e.main
    root = elements[0]
    for e in elements[1:]:
        wraps = 2 * e.main > root.main if root.main and not e.up.article else 2 * e.chars > root.chars
        e.never = e.up.never or e.own and (e.sure or not wraps)
    if root.main and all(e.never for e, _ in blocks if e.article):
        # All articles are spread over such elements.
        for e in elements[1:]:
            e.never = e.up.never or e.own and (e.sure or not (e.main and not e.up.article))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, parent, named, articles, nevers, pages, n, sig, chars, direct, least, most), combined within the task."""
    names = ["host", "path", "parent", "named", "articles", "nevers", "pages", "n", "sig", "chars", "direct", "least", "most"]
    types = [pa.string(), *[pa.int64()] * 12]
    sums: dict[tuple, list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for host, url, page in zip(*(batch.column(c).to_pylist() for c in ("host", "url", "html")), strict=True):
            elements, blocks = parse(page)
            seen: dict[int, list[int]] = {}
            words: dict[int, list[str]] = {}
            for e in elements:
                # A path is an article or boilerplate on a page if all its elements are.
                s = seen.setdefault(e.path, [(e.up.path if e.up else 0, int(e.named)), 1, 1, 0, 0, 0])
                s[1] &= e.is_article
                s[2] &= e.never
                s[3] += 1
            for e in elements:
                e.chars = 0
            for e, text in blocks:
                if not e.never:
                    seen[e.path][5] += len(text)
                    words.setdefault(e.path, []).append(text)
                    e.chars += len(text)
            for e in reversed(elements):
                seen[e.path][4] += e.chars
                if e.up is not None:
                    e.up.chars += e.chars
            name = xxhash.xxh64_intdigest(f"{url}\0{page}".encode("utf-8", "surrogatepass"))
            for path, ((parent, named), article, never, n, chars, direct) in seen.items():
                said = xxhash.xxh64_intdigest("\n".join(words[path]).encode("utf-8", "surrogatepass")) >> 1 if path in words else 0
                s = sums.setdefault((host, path, parent, named), [0, 0, 0, 0, 0, 0, 0, said, said])
                s[0] += article
                s[1] += never
                s[2] += 1
                s[3] += n
                s[4] += xxhash.xxh64_intdigest(b"%d %d" % (name, n)) >> 32
                s[5] += chars
                s[6] += direct
                s[7] = min(s[7], said)
                s[8] = max(s[8], said)
        if len(sums) >= HELD:
            yield flush()
    if sums:
        yield flush()


def _downward(up: dict[int, int]) -> list[int]:
    """All paths, each after the one that it hangs below."""
    below: dict[int, list[int]] = {}
    for path, parent in up.items():
        if path:
            below.setdefault(parent, []).append(path)
    out, at = [0], 0
    while at < len(out):
        out.extend(sorted(below.get(out[at], ())))
        at += 1
    return out


def deduced(rows: pd.DataFrame) -> tuple[list[int], list[int]]:
    """The article slots of a host's template (paths under which main text stands) and the paths whose words are template text. rows: the host's tokens."""
    up = dict(zip(rows["path"].tolist(), rows["parent"].tolist(), strict=True))
    pages = int(rows.loc[rows["path"] == 0, "pages"].iloc[0])
    rows = rows[rows["path"] != 0]
    frequent = rows[rows["pages"] >= MIN_SUPPORT * pages]
    # Equivalence classes: tokens with one occurrence vector. Words that never change are of their element's class.
    fixed = (frequent["least"] == frequent["most"]) & (frequent["direct"] > 0) & (frequent["pages"] >= MIN_PAGES)
    size = (1 + fixed).groupby([frequent[c] for c in ("pages", "n", "sig")]).transform("sum")
    valid = {0, *frequent.loc[size >= MIN_TOKENS, "path"].tolist()}
    down, often = _downward(up), set(frequent["path"].tolist())
    # Nested: all that a token hangs below is in the template; one without a valid class stands directly in a valid one (a list's items).
    template: set[int] = {0}
    for path in down:
        if path in often and up[path] in template and (path in valid or up[path] in valid):
            template.add(path)
    in_template = frequent["path"].isin(template)
    words = set(frequent.loc[fixed & in_template & frequent["path"].isin(valid), "path"].tolist())
    inside = frequent[in_template & (2 * frequent["nevers"] <= frequent["pages"])]
    marked = inside[(2 * inside["articles"] > inside["pages"]) & (inside["chars"] > 0)]
    if len(marked):
        slots = set(marked["path"].tolist())
    else:
        slots = set(_lowest(up, down, [p for p in rows.loc[rows["direct"] > 0, "path"].tolist() if p not in words], template))
    # Of nested articles the outermost; and what stands in a named element below one.
    within, own, named = set(), set(), set(rows.loc[rows["named"] > 0, "path"].tolist())
    for path in down[1:]:
        if up[path] in slots or up[path] in within:
            within.add(path)
            if path in named or up[path] in own:
                own.add(path)
    return sorted(slots - within), sorted(p for p in words if p in own or p not in within and p not in slots)


def _lowest(up: dict[int, int], down: list[int], texts: list[int], template: set[int]) -> list[int]:
    """The lowest element of the template that holds all of some paths; none if that is the root."""
    held = dict.fromkeys(down, 0)
    for path in texts:
        held[path] += 1
    for path in reversed(down[1:]):
        held[up[path]] += held[path]
    at = next((p for p in reversed(down) if p in template and held[p] == len(texts)), 0) if texts else 0
    return [at] if at else []


def templates(pages: DataFrame) -> DataFrame:
    """pages: (url, html). (host, slots, fixed): for each host, the paths of its article slots and those whose words are template text."""
    schema = "host string, path bigint, parent bigint, named bigint, articles bigint, nevers bigint, pages bigint, n bigint, sig bigint, chars bigint, direct bigint, least bigint, most bigint"
    tokens = pages.select(host_of(F.col("url")).alias("host"), "url", "html").mapInArrow(_tokens, schema)
    added = (F.sum(c).alias(c) for c in ("articles", "nevers", "pages", "n", "sig", "chars", "direct"))
    sums = tokens.groupBy("host", "path", "parent", "named").agg(*added, F.min("least").alias("least"), F.max("most").alias("most"))

    def of_host(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        slots, fixed = deduced(rows)
        return pd.DataFrame({"host": [key[0]], "slots": [slots], "fixed": [fixed]})

    return sums.groupBy("host").applyInPandas(of_host, "host string, slots array<bigint>, fixed array<bigint>")


def main_text(page: str | None, slots: set[int], fixed: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of a page's article slots without template text; with it, if there is nothing else; of all that may be main text, if it has nothing in the slots."""
    elements, blocks = parse(page)
    kept = [(e, text) for e, text in blocks if not e.never]
    slotted = set()
    for e in elements:
        if e.path in slots or id(e.up) in slotted:
            slotted.add(id(e))
    within = [(e, text) for e, text in kept if id(e) in slotted]
    for some in ([x for x in within if x[0].path not in fixed], within, kept):
        if some:
            return "\n".join(text for _, text in some)
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p, set(s or ()), set(f or ())) for p, s, f in zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "fixed")), strict=True)]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """pages: (page_id, url, html). (page_id, url, text, n_chars), a row each."""
    found = written(templates(pages), "templates")
    small = found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    both = rows.join(F.broadcast(found) if small else found, "host", "left").select("page_id", "url", "html", "slots", "fixed")
    return both.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
