"""Main text of web pages, and the tokens that make the template of a host's pages.

The main text is the article's blocks. Blocks of page furniture (navigation, header, footer, asides, notices, adverts,
forms, scripts, styles, comments) are known by their element, or by words of their class, id or role. Text is never
dropped for being repeated alone: headings that a site uses in all articles and pages that are copies keep theirs.

Templates: a page is a list of tokens, tags and texts, each with the path of open elements at its place. Tokens of a host
with the same occurrence vector (how often they stand on each of its pages) form an equivalence class; the vector is never
gathered, since an exclusive or of hashes over (page, number) tells vectors apart and can be built up in any order. A class
is valid if it has enough tokens, stands on enough of the host's pages, its tokens come in one order on every page (those
that do not are left out), and it nests: on every page it lies in one gap of any larger class, or holds that class in one
gap of its own. The valid classes of a host are its template; hosts of few pages take the template of all pages' tags.

A page is cut at the tokens of its template. What lies between two of them is a slot, and the template decides what it is.
Words make an element the article, or furniture inside an article, only if the element is the template's: what a page
itself puts into an article's slot, a notice or a section named like furniture, is its text. Outside articles, where no
slot vouches for the text, words of the page's own elements tell furniture. Elements that are furniture by name are so
everywhere, but the header of an article is part of it. The main text is the text of the article's slots and the
template's own text between them.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Set
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import plain, ranges, rows_batch
from tabprep.llm.hashing import mix
from tabprep.sources.storage import stored

#: Share of a host's pages on which a template class stands, and the pages a host needs to have classes of its own.
SUPPORT, LEAST_PAGES = 0.9, 8
#: Tokens of a class, at least; smaller classes are chance.
CLASS_TOKENS = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)

#: Fixed values of HTML: elements without content, elements whose content is no markup, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span "
                   "strike strong sub sup time tt u var wbr math mi mn mo mrow mtext".split())
FURNITURE = frozenset("nav header footer aside form script style noscript template head iframe button select textarea "
                      "menu dialog svg object audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                     "pre section table ul".split())
#: Words of class, id or role that mark furniture.
MARKS = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menus?|breadcrumbs?|sidebar\w*|side-bar|"
                   r"footer|header|masthead|comments?|disqus|replies|respond|cookies?|notices?|consent|gdpr|newsletter|"
                   r"subscribe|signup|login|share|sharing|social|related|recommend\w*|popup|modal|search|widgets?|"
                   r"navigation|contentinfo|complementary|toolbar|pagination|pager|disclaimer|alert)(?![a-z])")
ARTICLE = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|content|main|body-text|post-body)(?![a-z])")


class Element(NamedTuple):
    """What a start tag says of its element: furniture and article by name or by words, hidden, without content."""

    name: str
    token: str
    furniture: bool
    article: bool
    furniture_words: bool
    article_words: bool
    hidden: bool
    empty: bool


def _of_short(of):
    """The function with a cache for short texts, of which pages repeat few."""
    held = lru_cache(1 << 15)(of)
    return lambda text: held(text) if len(text) <= 200 else of(text)


@_of_short
def element(tag: str) -> Element | None:
    """The element of a start tag; None if it has no name."""
    name = _NAME.match(tag)
    if not name:
        return None
    name = name.group(1).lower()
    marks = " ".join(v for x in _MARKS.findall(tag) for v in x[1:]).lower()
    return Element(name, name + ("." + marks if marks else ""), name in FURNITURE, name in ("article", "main"),
                   bool(marks and MARKS.search(marks)), bool(marks and ARTICLE.search(marks)), bool(_HIDDEN.search(tag)),
                   name in VOID or tag.endswith("/>"))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_tag_digest = _of_short(_digest)


def tokens(page: str) -> Iterator[tuple[str, str, int, bool, int, int, Element | None]]:
    """(kind, token, path, furniture, article depth, level, element) in page order; kind is "open", "close", "text" or "raw".

    Browsers' rules in short: void elements have no end, a block ends an open paragraph, an end tag closes what is open
    inside it, an end tag without a start is nothing, and script-like elements run to their own end tag. A path is a hash of
    the open elements' names and of whether their own marks say furniture or article. The level is the number of elements
    open around the token; a start tag comes with its element.
    """
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # name, path, furniture and article elements up to it
    held: Counter[str] = Counter()
    at, lower = 0, None

    def pop() -> str:
        name = stack.pop()[0]
        held[name] -= 1
        return name

    while at < len(page):
        m = _TOKEN.match(page, at)
        token, at = m.group(), m.end()
        _, path, off, depth = stack[-1]
        if token[0] != "<" or len(token) == 1:
            yield "text", token, path, off > 0, depth, len(stack) - 1, None
            continue
        if token.startswith("<![CDATA["):
            yield "text", entities.escape(token[9:].removesuffix("]]>")), path, off > 0, depth, len(stack) - 1, None
            continue
        if token[1] == "/":
            name = _NAME.match(token)
            if not name:
                continue
            name = name.group(1).lower()
            if held[name] > 0:
                while pop() != name:
                    pass
            _, path, off, depth = stack[-1]
            yield "close", name, path, off > 0, depth, len(stack) - 1, None
            continue
        known = element(token)
        if known is None:
            continue
        name = known.name
        if name in CLOSES_P:
            last = len(stack) - 1
            while stack[last][0] in INLINE:
                last -= 1
            if stack[last][0] == "p":
                while len(stack) > last:
                    pop()
        elif name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name:
            pop()
        furniture = known.furniture or known.hidden or known.furniture_words and not known.article
        article = known.article or known.article_words
        _, path, off, depth = outer = stack[-1]
        inner = (name, _tag_digest(f"{path} {name} {furniture:d}{article:d}"), off + furniture, depth + article)
        # What follows an empty element stands outside it.
        behind = outer if known.empty else inner
        yield "open", known.token, inner[1], behind[2] > 0, behind[3], len(stack) - 1, known
        if name in RAW:
            lower = page.lower() if lower is None or len(lower) != len(page) else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else -1
            end = len(page) if end < 0 else end
            yield "raw", page[at:end], inner[1], True, inner[3], len(stack) - 1, None
            at = end
        if not known.empty:
            stack.append(inner)
            held[name] += 1


def numbered_tokens(page: str) -> Iterator[tuple[int, str, str, int, Element | None]]:
    """(number, kind, token, level, element) of a page's tokens; the number is a hash of kind, path and token.

    Its lowest bits say whether an article and furniture are open behind the token by their own marks, and whether it is
    text. Texts of white space only and raw content have no other bits; they are no tokens of a template.
    """
    for kind, token, path, off, depth, level, known in tokens(page):
        if kind == "text":
            name = " ".join(entities.unescape(token).split())
            number = _digest(f"{kind} {path} {name}") >> 4 << 4 if name else 0
        else:
            number = _tag_digest(f"{kind} {path} {token}") >> 4 << 4 if kind != "raw" else 0
        yield number | (depth > 0) << 2 | off << 1 | (kind == "text"), kind, token, level, known


def slots(page: str, template: Set[int]) -> list[tuple[int, list[tuple[bool, bool, str]]]]:
    """The page cut at the tokens of its template: the number of the token before a slot (0: the page's start), and its
    texts outside furniture, each with whether it starts a block and whether it is in an article.

    Words of an element count by what the template says of it and of the slot it stands in, see above. A text of the
    template is the first of the slot behind it.
    """
    out: list[tuple[int, list[tuple[bool, bool, str]]]] = [(0, [])]
    roles, new = [(False, False)], True  # furniture and article, of the elements open around a token
    for number, kind, token, level, known in numbered_tokens(page):
        ours = number in template
        if ours:
            out.append((number, []))
        if kind == "text":
            off, inside = roles[level]
            if off:
                new = True
                continue
            out[-1][1].append((new, inside, entities.unescape(token)))
            new = False
            continue
        if known is not None:
            off, inside = roles[level]
            words = known.furniture_words and not known.article and (ours or not inside)
            named = known.furniture and not (inside and known.name == "header")
            del roles[level + 1:]
            roles.append((off or named or known.hidden or words, inside or known.article or known.article_words and ours))
        if kind != "raw" and token.partition(".")[0] not in INLINE:
            new = True
    return out


def _host(url: str) -> Column:
    """The host of an address, in lower case; of a null, the empty host."""
    return F.substring_index(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", ""), "/", 1)


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each page's tokens in page order."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("numbers", pa.binary())])
    for batch in batches:
        lists = [np.array([x[0] for x in numbered_tokens(source or "")], np.uint64).tobytes() for source in batch.column(2).to_pylist()]
        yield rows_batch(schema, batch.column(0), batch.column(1), lists)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a batch of pages adds to the vectors of its hosts' tokens and, under the host null, of all pages' tags."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("pages", pa.int64()), ("place", pa.int64()), ("vector", pa.int64())])
    for batch in batches:
        hosts, lists = batch.column(0).dictionary_encode(), [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        if not sizes.sum():
            continue
        page, number = np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists)
        place = ranges(sizes)
        order = np.lexsort((place, number, page))
        page, number, place = page[order], number[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (number[1:] != number[:-1])]))
        times = np.diff(np.append(first, len(page)))
        page, number, place = page[first], number[first], place[first]
        keys = batch.column(1).to_numpy().view(np.uint64)
        vector = mix(mix(keys[page]) ^ times.astype(np.uint64))
        host = hosts.indices.to_numpy(zero_copy_only=False)[page]
        token, tag = number >> np.uint64(4) > 0, number & np.uint64(1) == 0
        for of, at in ((host, np.flatnonzero(token)), (np.full(len(host), -1), np.flatnonzero(token & tag))):
            if not len(at):
                continue
            at = at[np.lexsort((number[at], of[at]))]
            starts = np.flatnonzero(np.concatenate([[True], (of[at][1:] != of[at][:-1]) | (number[at][1:] != number[at][:-1])]))
            names = [hosts.dictionary[int(k)].as_py() if k >= 0 else None for k in of[at[starts]]]
            yield rows_batch(schema, names, number[at[starts]].view(np.int64), np.diff(np.append(starts, len(at))),
                             np.add.reduceat(place[at], starts), np.bitwise_xor.reduceat(vector[at], starts).view(np.int64))


def _by_class(classes: np.ndarray, held: np.ndarray, numbers: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(class, its tokens, their places on the page, a row for each round) of the candidates that the page has."""
    order, out = np.argsort(numbers, kind="stable"), []
    low, high = (np.searchsorted(numbers[order], held.view(np.uint64), side) for side in ("left", "right"))
    starts = np.flatnonzero(np.diff(classes, prepend=~classes[:1]))
    for a, b in zip(starts, [*starts[1:], len(classes)]):
        times = high[a:b] - low[a:b]
        if times[0] and (times == times[0]).all():
            out.append((int(classes[a]), held[a:b], order[low[a:b] + np.arange(times[0])[:, None]]))
    return out


def out_of_order(classes: np.ndarray, held: np.ndarray, numbers: np.ndarray) -> list[tuple[int]]:
    """Tokens that do not keep to the order of their class on the page, in some of its rounds.

    In round j every token stands behind all that come before it in the class, and before all of the next round.
    """
    bad = set()
    for _, tokens_, places in _by_class(classes, held, numbers):
        flat = places.reshape(-1)
        before = np.maximum.accumulate(np.append(-1, flat[:-1]))
        after = np.minimum.accumulate(np.append(flat[1:], len(numbers))[::-1])[::-1]
        bad.update(tokens_[np.flatnonzero((flat < before) | (flat > after)) % len(tokens_)].tolist())
    return [(x,) for x in bad]


def crossings(classes: np.ndarray, held: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of classes of which neither lies in the gaps of the other on the page, the one that comes first in the list first."""
    found, bad = _by_class(classes, held, numbers), []
    for k, (inner, _, small) in enumerate(found):
        for outer, _, large in found[:k]:
            # Gaps of a class are numbered by how many of its tokens stand before.
            gaps = (np.searchsorted(np.sort(x, axis=None), y) for x, y in ((large, small), (small, large)))
            if all((g != g[:, :1]).any() for g in gaps):
                bad.append((outer, inner))
    return bad


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of numbers of a column; a null is empty."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


def _checked(check, names: list[str], every: tuple[np.ndarray, np.ndarray]):
    """What a check finds on a page against its host's candidates and against those of all pages (host null)."""
    schema = pa.schema([("host", pa.string()), *((x, pa.int64()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for host, raw, classes, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)),
                                                _lists(batch.column(3)), strict=True):
                numbers = np.frombuffer(raw, np.uint64)
                for of, candidates in ((host, (classes, held)), (None, every)):
                    rows.update((of, *x) for x in check(*candidates, numbers))
            yield rows_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))
    return run


def _members(candidates: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Each host's candidates (classes, tokens) in the order of their classes, larger classes first; those of all pages as arrays.

    A list is about as long as a page has tokens, since each of its tokens stands on most pages of the host.
    """
    row = F.struct((-F.col("pages")).alias("few"), (-F.col("members")).alias("small"), "class_id", "place", "token")
    lists = stored(candidates.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("members")), "members")
    every = lists.where("host is null").first()
    return (lists.where("host is not null").select("host", F.col("members.class_id").alias("classes"), F.col("members.token").alias("tokens")),
            tuple(np.array([getattr(x, k) for x in every.members] if every else [], np.int64) for k in ("class_id", "token")))


def _with_sizes(tokens_: DataFrame) -> DataFrame:
    """The classes that have enough tokens, with their number."""
    size = tokens_.groupBy("host", "class_id").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= CLASS_TOKENS)
    return (tokens_.alias("t").join(size.alias("s"), F.expr("t.host <=> s.host and t.class_id = s.class_id"))
            .select("t.host", "t.class_id", "token", "pages", "place", "members"))


def _nested(rows: list, crossed: list) -> list:
    """Tokens of the classes that are left when of two crossing classes the smaller goes, the largest class first."""
    crossed, kept = {(x["outer"], x["inner"]) for x in crossed or []}, []
    for class_id in dict.fromkeys(x["class_id"] for x in rows):
        if not any((k, class_id) in crossed for k in kept):
            kept.append(class_id)
    return [x for x in rows if x["class_id"] in set(kept)]


def _templates(pages: DataFrame) -> DataFrame:
    """(host, members) of each host that has a template, and of all pages under the host null; ``pages`` has (url, html).

    Members are structs (class_id, place, token) among others. Equal pages of a host are one page, so copies do not make a
    template of their text.
    """
    named = pages.select(_host("url").alias("host"), "html").select("host", F.xxhash64("host", "html").alias("page"), "html")
    lists = stored(named.mapInArrow(_token_lists, "host string, page long, numbers binary").dropDuplicates(["host", "page"]), "lists")
    vectors = (lists.mapInArrow(_vectors, "host string, token long, pages long, place long, vector long").groupBy("host", "token")
               .agg(F.sum("pages").alias("pages"), F.sum("place").alias("place"), F.expr("bit_xor(vector)").alias("class_id")))
    held = lists.groupBy("host").agg(F.count(F.lit(1)).alias("held"))
    held = stored(held.union(held.agg(F.lit(None).cast("string"), F.sum("held"))).where(F.col("held") >= LEAST_PAGES), "hosts")
    frequent = (vectors.alias("v").join(held.alias("h"), F.expr("v.host <=> h.host")).where(F.col("pages") >= SUPPORT * F.col("held"))
                .select("v.host", "token", "pages", "place", "class_id"))
    found = stored(_with_sizes(stored(frequent, "frequent")), "classes")

    def against(members: DataFrame) -> DataFrame:
        return lists.join(members, "host", "left").select("host", "numbers", "classes", "tokens")

    members, every = _members(found)
    bad = against(members).mapInArrow(_checked(out_of_order, ["token"], every), "host string, token long").distinct()
    left = found.drop("members").alias("x").join(bad.alias("b"), F.expr("x.host <=> b.host and x.token = b.token"), "left_anti")
    found = stored(_with_sizes(stored(left, "ordered")), "classes")
    members, every = _members(found)
    crossed = (against(members).mapInArrow(_checked(crossings, ["outer", "inner"], every), "host string, outer long, inner long")
               .groupBy("host").agg(F.collect_set(F.struct("outer", "inner")).alias("crossed")))
    row = F.struct((-F.col("pages")).alias("few"), (-F.col("members")).alias("small"), "class_id", "place", "token")
    whole = found.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("members"))
    kind = "array<struct<few:long,small:long,class_id:long,place:long,token:long>>"
    return stored(whole.alias("x").join(crossed.alias("c"), F.expr("x.host <=> c.host"), "left")
                  .select("x.host", F.udf(_nested, kind)("members", "crossed").alias("members")), "templates")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("number", pa.int64()), ("token", pa.string())])
    for batch in batches:
        rows = set()
        for host, source, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wanted = {x & 0xFFFFFFFFFFFFFFFF for x in members}
            rows |= {(host, number, f"{kind} {token}") for number, kind, token, *_ in numbered_tokens(source or "") if number in wanted}
        numbers = np.array([x[1] for x in rows], np.uint64).view(np.int64)
        yield rows_batch(schema, [x[0] for x in rows], numbers, [x[2] for x in rows])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, class_id, token, place, pages) of the valid classes; ``pages`` has (page, url, html).

    ``place`` is the mean place of a token among its pages' tokens. Equal pages of a host are one page.
    """
    found = _templates(pages.select("url", "html")).where("host is not null")
    hosts = pages.select(_host("url").alias("host"), "html").join(
        found.select("host", F.col("members.token").alias("members")), "host")
    names = hosts.select("host", "html", "members").mapInArrow(_names, "host string, number long, token string")
    names = names.groupBy("host", "number").agg(F.min("token").alias("token"))
    each = found.select("host", F.explode("members").alias("x")).select("host", F.col("x.token").alias("number"), "x.class_id", "x.place", "x.few")
    return each.join(names, ["host", "number"]).select("host", "class_id", "token", (F.col("place") / -F.col("few")).alias("place"),
                                                       (-F.col("few")).alias("pages"))


def _extract(every: frozenset[int]):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [frozenset(x.view(np.uint64).tolist()) for x in _lists(batch.column(3))]
            texts = [main_text(source or "", own or every) for source, own in zip(batch.column(2).to_pylist(), found, strict=True)]
            yield rows_batch(schema, batch.column(0), batch.column(1), texts, [len(t) for t in texts])
    return run


def main_text(page: str, template: Set[int] = frozenset()) -> str:
    """Blocks of the article's slots joined by a space; of all slots outside furniture, if no article has text."""
    blocks: list[tuple[bool, list[str]]] = []
    for _, texts in slots(page, template):
        for new, article, text in texts:
            if new:
                blocks.append((article, []))
            blocks[-1][1].append(text)
    whole = [(article, text) for article, parts in blocks if (text := " ".join("".join(parts).split()))]
    found = [text for article, text in whole if article]
    return " ".join(found or [text for _, text in whole])


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row: the text of the article's slots, empty if there is none.

    Pages are cut by the template of their host, or by that of all pages. Null html is empty; repeated rows are pages of
    their own; an empty table stays empty; other columns are not read. A page without an article element gives all its
    blocks outside furniture.
    """
    own = pages.select(plain(key).cast("long").alias("page"), plain(url).cast("string").alias("url"), plain(html).cast("string").alias("html"))
    found = _templates(own.select("url", "html"))
    every = found.where("host is null").first()
    numbers = frozenset(x.token & 0xFFFFFFFFFFFFFFFF for x in every.members) if every else frozenset()
    templates = found.where("host is not null").select("host", F.col("members.token").alias("members"))
    cut = own.withColumn("host", _host("url")).join(templates, "host", "left").select("page", "url", "html", "members")
    return cut.mapInArrow(_extract(numbers), "page_id long, url string, text string, n_chars long")
