"""Benchmark passages in documents, found with an FM-index per shard of documents.

Words are numbered by the benchmark's vocabulary; all other words are one separator, and
runs shorter than the shortest window cannot hold one, so they are left out of the
shard's stream. Over the stream the task builds suffix order, Burrows-Wheeler transform,
a wavelet matrix for rank and sampled suffix positions. All windows are searched
backwards at once; the rows of a hit interval are located by walking to the next sampled
suffix, and the located spans are merged per document.

Shards are bounded by bytes, whatever the number of documents. The benchmark is broadcast
in slices of at most SLICE_WORDS words; more slices mean more passes, never less search.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; an
item without words has no window; repeated items count once; an item with a null item_id
hits words but is not listed; an empty benchmark hits nothing; rows that repeat a doc_id are
searched each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import prepare, raw_bytes

WIDTH = 10
SHARD_BYTES = 12 << 20
SLICE_WORDS = 2_000_000
SAMPLE = 8

# A-Z lower-cased, every other ASCII byte that is no digit or letter a space.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class FMIndex:
    """Full-text index of a stream of symbols; 0 separates runs, symbols are below `sigma`."""

    def __init__(self, stream: np.ndarray, sigma: int):
        n = len(stream)
        self.n, self.sigma = n, sigma
        order = self._suffix_order(stream)
        bwt = stream[order - 1]  # the suffix at 0 wraps to the last separator
        counts = np.bincount(stream, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt
        for b in range(self.levels - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        starts = np.empty(n, bool)
        starts[0] = True
        starts[1:] = stream[:-1] == 0
        kept = starts[order] | (order % SAMPLE == 0) | (stream[order] == 0)
        self.sampled = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.places = order[kept]
        self.bwt = bwt

    @staticmethod
    def _suffix_order(stream: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; separators are told apart by their place."""
        n = len(stream)
        separators = int((stream == 0).sum())
        rank = stream.astype(np.int64) + separators - 1
        rank[stream == 0] = np.arange(separators)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `upto` of the transform."""
        begin, end = np.zeros_like(upto), upto
        for depth, ones in enumerate(self.ones):
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            one_begin, one_end = ones[begin], ones[end]
            begin = np.where(bit == 1, self.zeros[depth] + one_begin, begin - one_begin)
            end = np.where(bit == 1, self.zeros[depth] + one_end, end - one_end)
        return end - begin

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of right-aligned patterns (padded on the left)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for back in range(width):
            live = np.flatnonzero((back < sizes) & (low < high))
            symbol = patterns[live, width - 1 - back]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Stream places of suffix rows, by steps back to the next sampled one."""
        place = np.empty(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        at, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            here = at[todo]
            found = self.sampled[here + 1] > self.sampled[here]
            done = todo[found]
            place[done] = self.places[self.sampled[at[done]]] + steps[done]
            todo = todo[~found]
            here = at[todo]
            symbol = self.bwt[here]
            at[todo] = self.first[symbol] + self.rank(symbol, here)
            steps[todo] += 1
        return place


class Windows:
    """The distinct windows of a slice of the benchmark and the items they belong to."""

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple, int] = {}
        owners: list[set] = []
        for item, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                k = number.setdefault(tuple(ids[i : i + size]), len(owners))
                if k == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[k].add(item)
        self.owners = [tuple(sorted(x)) for x in owners]
        self.sizes = np.array([len(w) for w in number], np.int64)
        self.patterns = np.zeros((len(number), width), np.int64)
        for k, window in enumerate(number):
            self.patterns[k, width - len(window) :] = window
        self.shortest = int(self.sizes.min()) if len(number) else 0

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
        """Word counts; merged spans as (document, first word, end); items per document."""
        counts = np.zeros(len(texts), np.int64)
        items: list[set] = [set() for _ in texts]
        none = np.empty((0, 3), np.int64)
        ids, sizes = [], counts
        get = self.vocabulary.get
        for k, text in enumerate(texts):
            words = words_of(text)
            counts[k] = len(words)
            ids.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))
        if not self.shortest or not texts:
            return counts, none[:, 0], none[:, 1:], items
        flat = np.concatenate(ids)
        stop = np.flatnonzero(flat == 0)  # every document ends with one
        length = np.diff(np.concatenate(([-1], stop))) - 1
        keep = np.flatnonzero(length >= self.shortest)
        if not len(keep):
            return counts, none[:, 0], none[:, 1:], items
        length = length[keep] + 1
        offset = np.concatenate(([0], np.cumsum(length)))
        source = np.repeat(stop[keep] + 1 - length - offset[:-1], length) + np.arange(offset[-1])
        stream = flat[source].astype(np.int64)
        index = FMIndex(stream, len(self.vocabulary) + 1)
        low, high = index.search(self.patterns, self.sizes)
        found = np.flatnonzero(high > low)
        times = (high - low)[found]
        window = np.repeat(found, times)
        rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(times)))[:-1], times) + np.arange(times.sum())
        place = index.locate(rows)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        word = source[place]
        doc = np.searchsorted(begins, word, side="right") - 1
        for d, k in np.unique(np.stack((doc, window), 1), axis=0):
            items[d].update(self.owners[k])
        cover = np.zeros(len(flat) + 1, np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + self.sizes[window], -1)
        hit = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))
        edge = np.diff(hit)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(begins, begin, side="right") - 1
        return counts, doc, np.stack((begin - begins[doc], end - begins[doc]), 1), items


def _slices(benchmark: DataFrame, width: int, slice_words: int) -> list:
    """Builders of the windows of slices that hold a bounded number of benchmark words."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (6 * slice_words)))

    def windows(part: int) -> Windows:
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        return Windows([(r[0], bytes(r[1])) for r in mine.distinct().toLocalIterator()], width)

    return [lambda part=part: windows(part) for part in range(parts)]


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    pending, size = [], 0
    for batch in batches:
        pending.append(batch)
        size += batch.nbytes
        if size >= shard_bytes:
            yield pa.Table.from_batches(pending)
            pending, size = [], 0
    if pending:
        yield pa.Table.from_batches(pending)


def _texts(shard: pa.Table) -> list[bytes]:
    return [t.encode() if t else b"" for t in shard.column("text").to_pylist()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep_text: bool = False,
                  shard_bytes: int = SHARD_BYTES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, items (ids as text), the merged word spans, and text
    where asked for."""
    context = prepare(docs.sparkSession).sparkContext
    frame = docs.select(
        "doc_id",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"),
        "text",
    )
    builders = _slices(benchmark, width, slice_words)
    for k, build in enumerate(builders):
        shared = context.broadcast(build())
        drop = k == len(builders) - 1 and not keep_text

        def search(batches, shared=shared, drop=drop) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, shard_bytes):
                found = _searched(shard, shared.value)
                yield from (found.drop_columns("text") if drop else found).to_batches()

        out = frame.drop("text").schema if drop else frame.schema
        frame = (frame.checkpoint() if k else frame).mapInArrow(search, out)
    return frame


def _searched(shard: pa.Table, windows: Windows) -> pa.Table:
    """The shard with what this slice of the benchmark adds to its columns."""
    counts, doc, spans, items = windows.hits(_texts(shard))
    all_spans = [[(x["first"], x["end"]) for x in row] for row in shard.column("spans").to_pylist()]
    for d, (a, b) in zip(doc.tolist(), spans.tolist(), strict=True):
        all_spans[d].append((a, b))
    listed = [sorted({*a, *map(str, b)}) for a, b in zip(shard.column("items").to_pylist(), items, strict=True)]
    put = {
        "n_words": counts,
        "items": listed,
        "spans": [[{"first": a, "end": b} for a, b in merged(x)] for x in all_spans],
    }
    for name, values in put.items():
        at = shard.schema.get_field_index(name)
        field = shard.schema.field(at)
        shard = shard.set_column(at, field, pa.array(values, field.type))
    return shard


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of its removal spans and what stands between them."""
    raw = text.encode()
    flat = raw.translate(_TABLE)
    bounds, at = [], 0
    for word in flat.split():
        begin = flat.index(word, at)
        at = begin + len(word)
        bounds.append((begin, at))
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : bounds[first][0]])
        at = bounds[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a benchmark window, with all their columns."""
    context = prepare(docs.sparkSession).sparkContext
    for k, build in enumerate(_slices(benchmark, WIDTH, SLICE_WORDS)):
        shared = context.broadcast(build())

        def keep(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, SHARD_BYTES):
                clean = np.ones(len(shard), bool)
                clean[shared.value.hits(_texts(shard))[1]] = False
                yield from shard.filter(pa.array(clean)).to_batches()

        docs = (docs.checkpoint() if k else docs).mapInArrow(keep, docs.schema)
    return docs
