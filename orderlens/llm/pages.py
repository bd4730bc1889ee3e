"""Main text of web pages: structure first, then a suffix array per host.

A page is read into blocks of text. Elements that never hold an article (menus, page headers
and footers, sidebars, notices, adverts, forms, scripts, comments of readers) are left out by
tag, role or class words; where a page marks an article or main element, only that part is
looked at. A class or id never drops an element that holds an article or main, except comments
after an article, whose articles are comments too; words such as has, no or enabled speak of
the page, not of the element. Inside an article the whole name has to say boilerplate, and a
heading's id, which repeats its text, says nothing.

Then the token streams of a host's pages are put one after another and their suffixes are
sorted. Token runs of RUN or more that come back on several distinct pages are boilerplate; the
runs between them stay, and so does a block of which less than half comes back. Where the page marks no article, two pages are enough. Inside a
marked article a block only goes if all of it comes back on WIDESPREAD of the distinct
pages, at least WIDE_PAGES: passages that articles share are text, not boilerplate. Pages with
equal text count as one.

A host's pages are dealt over shards of a bounded size, so that no task holds a whole host, but
pages are counted over the whole host. A text is counted in the one shard its hash names;
further copies of it are dealt by their ids and not counted, so the shards' counts add up. A run on WIDESPREAD
of the host's pages is on WIDESPREAD of those of some shard: the suffix arrays of the shards
name these runs, and only they are counted everywhere. Where a host has pages that mark no
article, all its runs are counted. Between shards runs are named by 64 bits.

Defined cases: null or empty html has an empty text of 0 characters; pages without a host (null
url) share the empty host; rows that repeat a page_id are treated each for itself, with equal
results for equal rows; unclosed elements end with the element around them; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import broadcast_if_small, prepare, written

RUN = 8
WIDESPREAD, WIDE_PAGES = 0.6, 10
# Words of a block that is running text.
PROSE_WORDS = 25
SHARD_BYTES = 4 << 20

# Element names and words of class, id and role attributes.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "aside button canvas footer head iframe input menu nav noscript script search select style svg template textarea"
    " title".split()
)
# Boilerplate unless they turn out to hold an article or main; a form's own controls always go.
WRAPPERS = {"form", "header", "fieldset", "dialog", "object"}
# Of these, what an article may hold as a part of its own.
PARTS_OF_ARTICLES = {"header", "fieldset", "object"}
HINTS = set(
    "ad ads adv advert advertisement advertising adverts banner sponsor sponsored promo promotion nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert"
    " newsletter subscribe subscription signup login search comment comments commentlist disqus replies reply"
    " discussion share sharing social related recommended recommendations widget popup modal overlay pager"
    " pagination skip toolbar complementary contentinfo".split()
)
OUTSIDE_HINTS = {"header"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies"}
STATES = {"has", "no", "not", "with", "without", "enabled", "disabled"}
# Inside an article: words that are also an article's own, and words that may stand beside a hint.
ORDINARY = set("notice notices alert discussion related recommended recommendations search login reply skip".split())
RELATED = {"related", "recommended"}
PARTS = set(
    "area articles bar block box buttons container content form icons inner items links list panel posts reader readers section"
    " stories thread user users wrap wrapper".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "select", "menu", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))",
    re.S,
)
_MARKS = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def _named(name: str, inside: bool) -> set[str]:
    """The words by which a class or an id names boilerplate."""
    words = [w.lower() for w in _WORDS.findall(name)]
    hints = HINTS.intersection(words)
    if STATES.intersection(words):
        return set()
    if not inside:
        return hints | OUTSIDE_HINTS.intersection(words)
    if not all(w in HINTS or w in PARTS for w in words):
        return set()
    return hints if hints - ORDINARY or (words and words[0] in RELATED and len(words) > 1) else set()


def _unwanted(tag: str, rest: str, inside: bool) -> str:
    """Whether an element is left out with all it holds; `inside` an article. "always", or by
    name alone: "hint" or "comments"; else empty."""
    if tag in DROPPED:
        return "always"
    if tag in WRAPPERS and not (inside and tag in PARTS_OF_ARTICLES):
        return "hint"
    if tag in ("html", "body", "article", "main") or "=" not in rest and "hidden" not in rest.lower():
        return ""
    hints: set[str] = set()
    for m in _MARKS.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "always"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "always"
        if name == "role":
            hints |= HINTS.intersection(value.lower().split())
        elif name in ("class", "id") and not (name == "id" and inside and tag in HEADINGS):
            for part in value.split():
                hints |= _named(part, inside)
    return "comments" if hints & COMMENTS else "hint" if hints else ""


class _Hinted:
    """An element that a name drops, unless it turns out to hold an article."""

    def __init__(self, around: _Hinted | None, closed: bool):
        self.around, self.closed, self.holds = around, closed, False


def blocks_of(html: str) -> tuple[list[str], bool]:
    """Blocks of visible text in page order, and whether they are from a marked article."""
    # tag, unwanted so far, inside an article, the innermost element that a name drops
    stack: list[tuple[str, bool, bool, _Hinted | None]] = []
    every: list[tuple[list[tuple[str, _Hinted | None]], bool]] = []
    current: list[tuple[str, _Hinted | None]] = []
    hinted: list[_Hinted] = []
    open_tags: dict[str, int] = {}
    open_blocks: list[int] = []  # places in the stack of elements that start or hold blocks
    seen = False  # an article or main
    at, size = 0, len(html)

    def cut(place: int) -> None:
        for entry in stack[place:]:
            open_tags[entry[0]] -= 1
        del stack[place:]
        while open_blocks and open_blocks[-1] >= place:
            open_blocks.pop()

    def end_block() -> None:
        if current:
            every.append((current.copy(), bool(stack) and stack[-1][2]))
            current.clear()

    def pop_to(place: int) -> None:
        end_block()
        cut(place)

    while at < size:
        here = html.find("<", at)
        if here < 0:
            here = size
        if here > at and not (stack and stack[-1][1]):
            current.append((unescape(html[at:here]), stack[-1][3] if stack else None))
        if here == size:
            break
        m = _TOKEN.match(html, here)
        if not m:
            if not (stack and stack[-1][1]):
                current.append(("<", stack[-1][3] if stack else None))
            at = here + 1
            continue
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag == "br":
                end_block()
            if open_tags.get(tag):
                # What is passed over here is closed with it.
                place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if any(x[0] in BLOCKS for x in stack[place:]):
                    pop_to(place)
                else:
                    cut(place)
            elif tag in BLOCKS:
                end_block()
            continue
        if tag in BLOCKS:
            end_block()
            for i in reversed(open_blocks):
                open_tag = stack[i][0]
                if open_tag == "p" or open_tag in ENDS_BEFORE.get(tag, ()):
                    cut(i)
                    break
                if open_tag in HOLDERS or (open_tag in BLOCKS and open_tag not in ENDS_BEFORE):
                    break
        unwanted, inside, around = stack[-1][1:] if stack else (False, False, None)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = size if close is None else (html.find(">", close.start()) + 1 or size)
            continue
        if tag in VOID or m["rest"].endswith("/>") and tag not in BLOCKS:
            continue
        why = "" if unwanted else _unwanted(tag, m["rest"], inside)
        if why in ("hint", "comments"):
            around = _Hinted(around, why == "comments" and seen)
            hinted.append(around)
        if tag in ("article", "main") and not unwanted:
            inside = seen = True
            above = around
            while above and not above.holds and not above.closed:
                above.holds, above = True, above.around
        if tag in BLOCKS or tag in HOLDERS:
            open_blocks.append(len(stack))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append((tag, unwanted or why == "always", inside or tag in ("article", "main"), around))
    end_block()
    left_out: set[_Hinted | None] = set()
    for x in hinted:
        if not x.holds or x.around in left_out:
            left_out.add(x)
    texts = [(" ".join("".join([t for t, x in parts if x not in left_out]).split()), inside) for parts, inside in every]
    texts = [(t, inside) for t, inside in texts if t]
    marked = [t for t, inside in texts if inside]
    # Articles that hold less than the running text beside them are cards, not the main part.
    prose = sum(len(t) for t, inside in texts if not inside and t.count(" ") >= PROSE_WORDS - 1)
    if marked and prose <= sum(map(len, marked)):
        return marked, True
    return [t for t, _ in texts], False


def _depth_ranks(stream: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first `depth` tokens, by prefix doubling."""
    rank, step = stream, 1
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
        step *= 2
    return rank


def _digest(text: str, size: int = 8) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


class Streams:
    """Token streams of the distinct pages among `pages`, one after another, each ended by a
    separator of its own. `run` is a power of two."""

    def __init__(self, pages: list[list[str]], run: int = RUN):
        self.run = run
        pages_at: dict[tuple, int] = {}
        self.number = [pages_at.setdefault(tuple(p), len(pages_at)) for p in pages]
        self.distinct = len(pages_at)
        self.vocabulary: dict[str, int] = {}
        place = self.vocabulary.setdefault
        texts = [np.array([place(t, len(self.vocabulary)) for b in p for t in b.split(" ")], np.int64) for p in pages_at]
        parts: list[np.ndarray] = []
        for n, t in enumerate(texts):
            parts += [t, np.array([len(self.vocabulary) + n])]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes + 1)
        self.stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.distinct), self.sizes + 1)
        # Places where a run begins that ends before its page does.
        self.whole = np.arange(len(self.stream)) + run < self.ends[self.owner] if parts else np.zeros(0, bool)

    def spread(self) -> np.ndarray:
        """On how many distinct pages the run that begins at a place comes back, by sorted
        suffixes. A run that reaches past a page's end holds its separator, so it comes back
        nowhere."""
        if not self.vocabulary:
            return np.zeros(len(self.stream), np.int64)
        rank = _depth_ranks(self.stream, self.run)
        pairs = np.unique(rank * self.distinct + self.owner)
        return np.bincount(pairs // self.distinct, minlength=int(rank.max()) + 1)[rank]

    def keys(self) -> np.ndarray:
        """64 bits that name the run that begins at a place, the same in every shard."""
        names = np.frombuffer(b"".join(map(_digest, self.vocabulary)), np.uint64)
        tokens = np.append(names, np.zeros(self.distinct, np.uint64))[self.stream]
        out = np.zeros(len(tokens), np.uint64)
        for k in range(self.run):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out[: len(tokens) - k] += tokens[k:]
        return out.view(np.int64)

    def covers(self, spread: np.ndarray) -> list[np.ndarray]:
        """Per token of every page: the largest spread of the runs that cover it."""
        cover = spread.copy()
        for back in range(1, min(self.run, len(spread))):
            cover[back:] = np.maximum(cover[back:], spread[:-back])
        out = [cover[e - n - 1 : e - 1] for n, e in zip(self.sizes, self.ends, strict=True)]
        return [out[n] for n in self.number]


def repeated(pages: list[list[str]], run: int = RUN) -> tuple[list[np.ndarray], int]:
    """Per token of every page: on how many distinct pages a run that covers it comes back,
    and the number of distinct pages. `run` is a power of two."""
    own = Streams(pages, run)
    return own.covers(own.spread()), own.distinct


def main_texts(pages: list[list[str]], marked: list[bool], spreads: list[np.ndarray], distinct: int) -> list[str]:
    """Texts of pages without what the `distinct` pages of their host share as boilerplate."""
    wide = max(WIDE_PAGES, WIDESPREAD * distinct)
    out = []
    for blocks, whole, spread in zip(pages, marked, spreads, strict=True):
        kept, at = [], 0
        for block in blocks:
            tokens = block.split(" ")
            mine = spread[at : at + len(tokens)]
            at += len(tokens)
            if whole:
                if not len(mine) or mine.min() < wide:
                    kept.append(block)
            else:
                shared = mine >= 2
                if shared.mean() < 0.5:  # a run of the block before reaches in
                    shared[:] = False
                unique = [t for t, s in zip(tokens, shared, strict=True) if not s]
                if unique:
                    kept.append(" ".join(unique))
        out.append("\n".join(kept))
    return out


def _asked(shard: pa.Table) -> pa.Table:
    """What a shard of several knows of its host: a row (run null) with its number of distinct
    pages, and a row per run that is widespread in it."""
    host, shards = shard.column("host")[0].as_py(), shard.column("shards")[0].as_py()
    pages, unmarked, runs = [], [], np.zeros(0, np.int64)
    if shards > 1:
        own = Streams(shard.filter(shard.column("counted")).column("blocks").to_pylist())
        if own.distinct:
            runs = np.unique(own.keys()[own.whole & (own.spread() >= WIDESPREAD * own.distinct - 1e-6)])
        pages, unmarked = [own.distinct], [not all(shard.column("marked").to_pylist())]
    n = len(runs)
    rows = len(pages) + n
    return pa.table({
        "host": pa.array([host] * rows, pa.string()), "shards": pa.array([shards] * rows, pa.int64()),
        "run": pa.concat_arrays([pa.nulls(len(pages), pa.int64()), pa.array(runs)]),
        "pages": pa.array(pages + [0] * n, pa.int64()), "unmarked": pa.array(unmarked + [False] * n, pa.bool_()),
    })


def _counted(shard: pa.Table, asked: pa.Table) -> pa.Table:
    """Distinct pages of the shard with a run, for the runs asked for, or for all of them if the
    host has pages that mark no article; the host's distinct pages, and whether it has such."""
    runs = pages = np.zeros(0, np.int64)
    distinct, unmarked = sum(asked.column("distinct").to_pylist()), any(asked.column("unmarked").to_pylist())
    if len(shard) and (unmarked or len(asked) > 1):
        own = Streams(shard.column("blocks").to_pylist())
        at = np.flatnonzero(own.whole)
        key = own.keys()[at]
        if not unmarked:
            wanted = np.isin(key, asked.column("run").drop_null().to_numpy())
            at, key = at[wanted], key[wanted]
        # A text of which only further copies are here is counted in another shard.
        counted = np.zeros(own.distinct, bool)
        counted[np.array(own.number)[np.array(shard.column("counted").to_pylist(), bool)]] = True
        runs, where = np.unique(key, return_inverse=True)
        pairs = np.unique(where * max(1, own.distinct) + own.owner[at])
        pages = np.bincount(pairs // max(1, own.distinct), counted[pairs % max(1, own.distinct)], len(runs)).astype(np.int64)
    n = len(runs)
    host, place = (shard.column(c)[0].as_py() if n else None for c in ("host", "shard"))
    return pa.table({
        "host": pa.array([host] * n, pa.string()), "shard": pa.array([place] * n, pa.int64()),
        "run": pa.array(runs, pa.int64()), "pages": pa.array(pages, pa.int64()),
        "distinct": pa.array([distinct] * n, pa.int64()), "unmarked": pa.array([unmarked] * n, pa.bool_()),
    })


def _cleaned(shard: pa.Table, shared: pa.Table) -> pa.Table:
    """page_id, url, text and n_chars of a shard's pages, given the runs (run, spread) that it
    shares with other pages of the host and the host's number of distinct pages."""
    blocks = shard.column("blocks").to_pylist()
    own = Streams(blocks)
    if not len(shard) or shard.column("shards")[0].as_py() == 1:
        spread, distinct = own.spread(), own.distinct
    else:
        spread, distinct = np.ones(len(own.stream), np.int64), 0
        if len(shared):
            distinct = shared.column("distinct")[0].as_py()
            runs, spreads = (shared.column(c).to_numpy() for c in ("run", "spread"))
            order = np.argsort(runs)
            key = own.keys()
            at = order[np.minimum(np.searchsorted(runs[order], key), len(runs) - 1)]
            spread = np.where(own.whole & (runs[at] == key), spreads[at], 1)
    texts = main_texts(blocks, shard.column("marked").to_pylist(), own.covers(spread), distinct)
    return pa.table({
        "page_id": shard.column("page_id"), "url": shard.column("url"), "text": pa.array(texts, pa.string()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
    })


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    prepare(pages.sparkSession)
    frame = pages.select("page_id", "url", "html").withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    )
    kind = {f.name: f.dataType.simpleString() for f in frame.schema}
    ids = f"page_id {kind['page_id']}, url {kind['url']}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            parsed = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
            blocks = pa.array([p[0] for p in parsed], pa.list_(pa.string()))
            names, first = [], []
            for host, (texts, _) in zip(batch.column("host").to_pylist(), parsed, strict=True):
                names.append(_digest("\n".join([host, *texts]), 16))
                first.append(names[-1] not in seen)
                seen.add(names[-1])
            arrays = [batch.column(c) for c in ("page_id", "url", "host")]
            arrays += [blocks, pa.array([p[1] for p in parsed], pa.bool_())]
            arrays += [pa.array([int.from_bytes(n[:8], "big", signed=True) for n in names], pa.int64()), pa.array(first, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "blocks", "marked", "name", "counted"])

    blocks = frame.select("page_id", "url", "host", "html").mapInArrow(
        read, f"{ids}, host string, blocks array<string>, marked boolean, name long, counted boolean"
    )
    size = F.sum(F.octet_length("html")) / shard_bytes
    shards = frame.groupBy("host").agg(F.greatest(F.ceil(size), F.lit(1)).alias("shards"))
    shards = broadcast_if_small(written(shards.select("host", F.coalesce("shards", F.lit(1)).alias("shards")), "hosts"))
    # The first copy of a text that a task reads goes where the text is counted, the others
    # are spread, so that a text with many copies does not fill one shard.
    place = F.pmod(F.when(F.col("counted"), F.col("name")).otherwise(F.xxhash64("page_id", "url")), F.col("shards"))
    dealt = blocks.join(shards, "host").withColumn("shard", place)
    dealt = dealt.select("page_id", "url", "blocks", "marked", "counted", "host", "shard", "shards").repartition("host", "shard")
    # All three steps read the one exchange of `dealt`.
    groups = dealt.groupBy("host", "shard")
    asked = groups.applyInArrow(_asked, "host string, shards long, run long, pages long, unmarked boolean")
    asked = asked.groupBy("host", "run").agg(
        F.max("shards").alias("shards"), F.sum("pages").alias("distinct"), F.max("unmarked").alias("unmarked")
    )
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    counts = groups.cogroup(asked.groupBy("host", "shard")).applyInArrow(
        _counted, "host string, shard long, run long, pages long, distinct long, unmarked boolean"
    )
    least = F.when(F.col("unmarked"), F.lit(2.0)).otherwise(F.greatest(F.lit(float(WIDE_PAGES)), WIDESPREAD * F.col("distinct")))
    spread = F.sum("pages").over(Window.partitionBy("host", "run"))
    shared = counts.withColumn("spread", spread).where(F.col("spread") >= least).select("host", "shard", "run", "spread", "distinct")
    return groups.cogroup(shared.groupBy("host", "shard")).applyInArrow(_cleaned, f"{ids}, text string, n_chars long")
