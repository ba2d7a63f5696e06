"""Main text of pages by wrappers: regular expressions without unions, inferred per host.

A page is a stream of blocks, each named by its path of elements, with a text. Runs of blocks
that repeat are folded. The streams of all pages of a host are aligned: what occurs in both stays,
what occurs in one becomes optional, what repeats in either becomes repeated, and a text that
differs becomes a slot, while one that is the same everywhere is the host's own. Pages of one
structure are aligned where they are read, different structures then in rounds. The result is the
wrapper of the host. Every page is then matched with its wrapper; the slots of
the article give the text.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.url_filter import host_and_path
from paneltide.sources.io import stage_via_parquet

#: Wrappers of a host that one task aligns; more are aligned in rounds.
ALIGNED_AT_ONCE = 32
#: Pages with the same constant text in a slot before the text counts as the host's own.
CONSTANT_PAGES = 4
#: Wrappers are broadcast up to this many characters in all, else joined by a shuffle.
BROADCAST_CHARS = 16_000_000

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""script style noscript template svg math head title iframe object audio video
    canvas select option datalist textarea button form nav header footer aside dialog menu""".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark
    q s samp small span strike strong sub sup time tt u var wbr img""".split())
CLOSES_PARAGRAPH = frozenset("""address article aside blockquote details div dl fieldset figure
    figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul
    """.split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
              "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
              "tbody": {"tbody", "thead", "tr", "td", "th"}}
MAIN = frozenset({"article", "main"})
# Words in class, id and role that mark what is not the article.
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|"
    r"side-?bar|header|masthead|footer|cookie\w*|consent|notice\w*|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|comments?|comment-\w+|reply|replies|disqus|share|sharing|"
    r"social|related|recommend\w*|widget|toolbar|pagination|pager|tags?|byline-share|"
    r"contentinfo|complementary|navigation|search|hidden)(?=$|[\s_-])", re.IGNORECASE)

_OPEN = r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
_TOKEN = re.compile(_OPEN + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<", re.DOTALL)
#: As above, where a quote that never ends has been met: the first > ends a tag.
_PLAIN_TOKEN = re.compile(_OPEN + r"([^>]*+)>|<", re.DOTALL)
_TAG_NAME = re.compile(r"/?[a-zA-Z]")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))",
                    re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true",
                     re.IGNORECASE)
_SPACE = re.compile(r"\s+")


# Words in a class or id that mark what is not the article even inside it, where they stand alone.
_INNER_WORDS = frozenset("""ad ads advert advertisement banner promo sponsor sponsored nav menu sidebar
    footer cookie cookies consent popup modal newsletter subscribe signup login comment comments reply
    replies disqus share sharing social related recommended widget toolbar pagination pager complementary
    navigation""".split())


class Block(NamedTuple):
    #: A hash of the names and marks of the elements around the block.
    path: str
    text: str
    chrome: bool
    main: bool


def blocks_of(page: str) -> list[Block]:
    """The texts of a page in order, one per block, with their paths.

    Unclosed elements are closed as browsers do: a paragraph by the next block, list items and
    cells by the next one, anything by the end of what holds it. A ``<`` that opens no tag is
    text; comments and the content of scripts and styles are not.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]   # name, path, chrome, main
    open_names: Counter[str] = Counter()
    text: list[str] = []
    token = _TOKEN

    def flush() -> None:
        words = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if words:
            _, path, chrome, main = stack[-1]
            out.append(Block(path, words, chrome, main))

    def close_to(names: frozenset[str] | set[str], stop: frozenset[str] | set[str] = frozenset()) -> None:
        if not any(open_names[name] for name in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                flush()
                open_names.subtract(x[0] for x in stack[depth:])
                del stack[depth:]
                return
            if stack[depth][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        tag = token.search(page, at)
        if tag is None:
            text.append(page[at:])
            break
        text.append(page[at:tag.start()])
        at = tag.end()
        name = tag.group(2)
        if name is None:
            if tag.group() == "<":
                text.append("<")
                if _TAG_NAME.match(page, at):
                    # A tag without an end: without any > the rest is text, else quotes are looked
                    # for no more. Either way the page is read to its end only once.
                    if page.find(">", at) < 0:
                        text.append(page[at:])
                        break
                    token = _PLAIN_TOKEN
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if tag.group(1):
            if name == "br":
                flush()
            close_to({name})
            continue
        if name in ("br", "hr"):
            flush()
            continue
        if name in VOID:
            continue
        if name in RAW:
            flush()
            closing = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else end
            continue
        flush()
        if name in CLOSES_PARAGRAPH:
            close_to({"p"}, stop={"td", "th", "li", "div", "article", "section", "main"})
        if name in SAME_LEVEL:
            close_to(SAME_LEVEL[name], stop={"ul", "ol", "dl", "table"})
        marks = " ".join(next(filter(None, m), "") for m in _NAMED.findall(tag.group(3)))
        above = stack[-1]
        # Inside the article a word counts only where it stands alone: social-science is a topic.
        named = (not _INNER_WORDS.isdisjoint(marks.lower().split()) if above[3]
                 else bool(marks and CHROME.search(marks)))
        chrome = above[2] or name in DROPPED or named or bool(_HIDDEN.search(tag.group(3)))
        if name == "header" and above[3]:
            chrome = above[2]     # the heading of the article itself
        label = name + ("." + _SPACE.sub(".", marks.strip().lower()) if marks else "")
        path = xxhash.xxh64_hexdigest(f"{above[1]}/{label}")
        stack.append((name, path, chrome, above[3] or name in MAIN))
        open_names[name] += 1
    flush()
    return out


class Item(NamedTuple):
    """A group of blocks in a wrapper."""

    paths: tuple[str, ...]
    repeated: bool
    optional: bool
    #: Per block: a text that all pages so far share, or None for a slot.
    texts: tuple[str | None, ...]
    pages: int


def fold(blocks: list[Block]) -> list[tuple[tuple[str, ...], list[list[int]]]]:
    """Groups of paths in order with the places of their blocks; adjacent repeats are one group.

    A group ends before the next block of its first path, so it may be of any length.
    """
    paths = [b.path for b in blocks]
    following, last = [len(paths)] * len(paths), {}
    for i in range(len(paths) - 1, -1, -1):
        following[i] = last.get(paths[i], len(paths))
        last[paths[i]] = i
    out, at = [], 0
    while at < len(paths):
        period, times = following[at] - at, 1
        if following[at] < len(paths):
            while (at + (times + 1) * period <= len(paths) and paths[at + times * period] == paths[at]
                   and paths[at:at + period] == paths[at + times * period:at + (times + 1) * period]):
                times += 1
        if times == 1:
            period = 1
        out.append((tuple(paths[at:at + period]),
                    [list(range(at + i * period, at + (i + 1) * period)) for i in range(times)]))
        at += period * times
    return out


def _items(blocks: list[Block]) -> list[Item]:
    return [Item(paths, len(places) > 1, False,
                 tuple(blocks[i].text if len(places) == 1 else None for i in places[0]), 1)
            for paths, places in fold(blocks)]


def _aligned(left: list[tuple[str, ...]], right: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Pairs of equal groups, in order on both sides, in time near the number of groups.

    Equal beginnings and ends pair up; between them, groups that occur once on either side are
    anchors, of which a longest increasing run is taken, and the gaps are aligned in the same way.
    Without any, the first, second, ... occurrences of a group on either side are anchors.
    """
    pairs, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        once = Counter(left[a:b])
        place = {x: j for j, x in enumerate(right[c:d], c)}
        both = Counter(right[c:d])
        anchors = _increasing([(i, place[x]) for i, x in enumerate(left[a:b], a)
                               if once[x] == 1 and both[x] == 1])
        if not anchors:
            nth = {x: j for j, x in enumerate(_numbered(right[c:d]), c)}
            anchors = _increasing([(i, nth[x]) for i, x in enumerate(_numbered(left[a:b]), a) if x in nth])
        if not anchors:
            continue
        pairs += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(pairs)


def _numbered(groups: list[tuple[str, ...]]) -> list[tuple[tuple[str, ...], int]]:
    seen: Counter[tuple[str, ...]] = Counter()
    out = []
    for group in groups:
        out.append((group, seen[group]))
        seen[group] += 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that grows on the right; the left grows already."""
    tails, ends, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(wrapper: list[Item], page: list[Item]) -> list[Item]:
    """The wrapper that also accepts ``page``: mismatches become optional, repeated or slots."""
    out, i, j = [], 0, 0
    for a, b in [*_aligned([x.paths for x in wrapper], [x.paths for x in page]),
                 (len(wrapper), len(page))]:
        out += [x._replace(optional=True) for x in (*wrapper[i:a], *page[j:b])]
        if a < len(wrapper):
            x, y = wrapper[a], page[b]
            same = tuple(s if s == t else None for s, t in zip(x.texts, y.texts, strict=True))
            out.append(Item(x.paths, x.repeated or y.repeated, x.optional or y.optional, same,
                            x.pages + y.pages))
        i, j = a + 1, b + 1
    return out


def infer_wrapper(pages: list[str]) -> list[Item]:
    """Fold and align the pages in the order given."""
    wrapper: list[Item] | None = None
    for page in pages:
        items = _items(blocks_of(page))
        wrapper = items if wrapper is None else align(wrapper, items)
    return wrapper or []


def extract(page: str, wrapper: list[Item]) -> str:
    """The article's blocks, joined by line breaks.

    What lies in elements or classes that aren't the article goes. Within an article or main
    element everything else stays, also what other pages of the host say in the same words.
    Without one, blocks that match an item of the wrapper whose text is constant over enough pages
    are the host's own and go, and everything else stays.
    """
    blocks = blocks_of(page)
    groups = fold(blocks)
    own = set()
    for a, b in _aligned([x.paths for x in wrapper], [g[0] for g in groups]):
        item = wrapper[a]
        if item.pages >= CONSTANT_PAGES and not item.repeated and len(groups[b][1]) == 1:
            own |= {i for i, t in zip(groups[b][1][0], item.texts, strict=True)
                    if t is not None and t == blocks[i].text}
    kept = [(i, b) for i, b in enumerate(blocks) if not b.chrome]
    inside = [b for _, b in kept if b.main]
    return "\n".join(b.text for b in inside or [b for i, b in kept if i not in own])


def _coded(wrapper: list[Item]) -> str:
    return json.dumps(wrapper)


def _decoded(code: str) -> list[Item]:
    return [Item(tuple(x[0]), x[1], x[2], tuple(x[3]), x[4]) for x in json.loads(code)]


def _structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for the pages of a batch that have a host and a sequence of groups in common."""
    for batch in batches:
        made: dict[tuple[str, str], list[Item]] = {}
        for host, page in zip(batch["host"], batch["html"].fillna(""), strict=True):
            items = _items(blocks_of(page))
            key = host, xxhash.xxh128_hexdigest(json.dumps([x.paths for x in items]))
            made[key] = align(made[key], items) if key in made else items
        yield pd.DataFrame([(*key, _coded(w)) for key, w in made.items()], columns=["host", "key", "wrapper"])


def _aligned_rows(rows: pd.DataFrame) -> str:
    """The rows' wrappers aligned in the order of their keys."""
    made: list[Item] | None = None
    for code in rows.sort_values(["key", "wrapper"])["wrapper"]:
        made = _decoded(code) if made is None else align(made, _decoded(code))
    return _coded(made or [])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from all pages of each host.

    Pages of equal structure become one wrapper in their batch and one per host after a shuffle, so
    a host with a third of all pages sends its structures, not its pages. Different structures are
    aligned ``ALIGNED_AT_ONCE`` at a time, in an order that follows from the structures alone.
    """
    def same(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "key": [key[1]], "wrapper": [_aligned_rows(rows)]})

    def lot(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "key": [f"{key[1]:020d}"], "wrapper": [_aligned_rows(rows)]})

    schema = "host string, key string, wrapper string"
    made = stage_via_parquet(pages.select("host", "html").mapInPandas(_structures, schema)
                             .groupBy("host", "key").applyInPandas(same, schema))
    while True:
        sizes = made.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return made.select("host", "wrapper")
        number = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / ALIGNED_AT_ONCE))
        made = stage_via_parquet(made.join(sizes, "host").withColumn("lot", number).drop("n")
                                 .groupBy("host", "lot").applyInPandas(lot, schema))


def extract_text(rows: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row (columns page_id, url, html).

    Null html is an empty page. Pages without a host share one wrapper. Repeated rows are
    extracted each. A page that the wrapper doesn't fit is judged by its own elements.
    """
    pages = rows.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))
    made = stage_via_parquet(wrappers(pages))
    total = made.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    pages = pages.join(F.broadcast(made) if total <= BROADCAST_CHARS else made, "host", "left")
    # Ids cross as text, so that a null among them doesn't turn the others into floats.
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "wrapper")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, list[Item]] = {}
        for batch in batches:
            texts = []
            for page, code in zip(batch["html"].fillna(""), batch["wrapper"].fillna("[]"), strict=True):
                if code not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[code] = _decoded(code)
                texts.append(extract(page, parsed[code]))
            yield batch[["page_id", "url"]].assign(text=texts)

    return (pages.mapInPandas(run, "page_id string, url string, text string")
            .select(F.col("page_id").cast("long").alias("page_id"), "url", "text",
                    F.length("text").cast("long").alias("n_chars")))
