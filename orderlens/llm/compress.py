"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ORDER bytes, counted over all training texts. At a
position the longest known context predicts; if the byte was never seen there, an escape
(method C: as likely as the number of distinct followers) leads to the next shorter context,
whose counts leave out the followers already ruled out (symbol exclusion), down to a uniform
share of what is left. The end of a text is a symbol of its own, and contexts know the
beginning of a text. The trie is fixed when scoring starts, so exclusions depend on the
contexts alone and are summed up beforehand; a batch of texts is then scored in numpy.

Counting covers every training text: tasks count the longest grams and the words of their
texts, Spark adds them up, and shorter contexts are sums of the longer ones. What a position
costs depends on its longest gram alone. A trie of up to NODES grams is sent to the tasks and
settles everything there. Of a larger one the tasks get the most frequent longest grams with
their costs, worked out from all counts; a document's other grams meet theirs in a join, and
those that no training text has go down the levels in joins with the full tables. The scores
are the same either way, NODES only says how much is settled without a join.

The base score needs the count of every word. The FREQUENT most frequent ones are sent to
the tasks; words beyond them meet their counts in a join, so none is left out.

Defined cases: null text counts as empty and is its end symbol alone; a null doc_id is not
held out; without training texts every symbol is equally likely and no token is known; rows
that repeat a doc_id are scored, and learnt from, one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import held_out, kept, prepare, raw_bytes, written
from orderlens.llm.words import KeyTable

ORDER = 4
NODES = 1_000_000
FREQUENT = 100_000
FOLDS, HELD_FOLD = 7, 2
END, BEGIN, SYMBOLS = 256, 257, 257
BITS = 9
COUNTED_BYTES = 2 << 20
SCORED_BYTES = 1 << 20
COUNTED_WORDS = 150_000
# Words of more bytes are never held: without spaces a word is a whole document.
WORD_BYTES = 64
HISTOGRAM = 1 << 16


def stream(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after `order` begin marks and before its end, and the
    places that are predicted."""
    pad = order
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + pad + 1)))
    out = np.full(begin[-1], BEGIN, np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(len(flat)) + np.repeat(np.arange(1, len(texts) + 1) * pad + np.arange(len(texts)), sizes)
    out[at] = flat
    out[begin[1:] - 1] = END
    return out, np.flatnonzero(out != BEGIN)


def grams(symbols: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The last `size` symbols up to each place as one integer, the place's own last."""
    key = np.zeros(len(places), np.int64)
    for back in range(size - 1, -1, -1):
        key = (key << BITS) | symbols[places - back]
    return key


class Trie:
    """The counts of all gram sizes, with everything scoring needs worked out."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[j]: sorted keys and counts of the grams of j + 1 symbols."""
        self.grams, self.contexts, self.info = [], [], []
        below = None
        for keys, counts in levels:
            owner = keys >> BITS
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            total = np.add.reduceat(counts, begin).astype(float) if len(begin) else np.zeros(0)
            kinds = np.diff(np.append(begin, len(keys))).astype(float)
            context = owner[begin]
            own = np.repeat(np.arange(len(begin)), kinds.astype(int))
            info = {
                "count": np.log10(counts), "hit": np.log10(counts / (total + kinds)[own]),
                "escape": np.log10(kinds / (total + kinds)),
            }
            if below is not None:
                # What a byte costs one level down once this context's followers are ruled out.
                j = len(self.grams)
                mask = (1 << (BITS * j)) - 1
                shorter = np.searchsorted(below["keys"], keys & mask)
                excluded = np.add.reduceat(below["counts"][shorter], begin) if len(begin) else np.zeros(0)
                up = np.searchsorted(below["context"], context & ((1 << (BITS * (j - 1))) - 1))
                left = below["kinds"][up] - kinds
                rest = below["total"][up] - excluded + left
                with np.errstate(divide="ignore"):
                    info["rest"] = np.log10(rest)
                    info["pass"] = np.where(left > 0, np.log10(left) - np.log10(np.maximum(rest, 1)), 0.0)
                info["up"] = up.astype(np.int32)
            below = {"keys": keys, "counts": counts, "context": context, "total": total, "kinds": kinds}
            self.grams.append(KeyTable(keys.astype(np.uint64)))
            self.contexts.append(KeyTable(context.astype(np.uint64)))
            self.info.append({k: v.astype(np.int32 if k == "up" else np.float32) for k, v in info.items()})
        known = len(levels[0][0]) if levels else 0
        self.least = float(np.log10(1.0 / max(1, SYMBOLS - known)))

    def log10(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol at each place."""
        out = np.zeros(len(places))
        order = len(self.grams)
        fresh = np.arange(len(places))  # no context known so far
        escaped, context = np.empty(0, np.int64), np.empty(0, np.int32)
        for j in range(order - 1, -1, -1):
            info = self.info[j]
            if len(escaped):
                # Out of a longer context: what it saw is excluded here.
                above = self.info[j + 1]
                hit = self.grams[j].find(grams(symbols, places[escaped], j + 1).astype(np.uint64))
                found = hit >= 0
                out[escaped[found]] += info["count"][hit[found]] - above["rest"][context[found]]
                out[escaped[~found]] += above["pass"][context[~found]]
                escaped, context = escaped[~found], above["up"][context[~found]]
            key = grams(symbols, places[fresh], j + 1)
            hit = self.grams[j].find(key.astype(np.uint64))
            found = hit >= 0
            out[fresh[found]] += info["hit"][hit[found]]
            fresh, key = fresh[~found], key[~found]
            owner = self.contexts[j].find((key >> BITS).astype(np.uint64))
            known = owner >= 0
            out[fresh[known]] += info["escape"][owner[known]]
            escaped = np.concatenate((escaped, fresh[known]))
            context = np.concatenate((context, owner[known]))
            fresh = fresh[~known]
        out[escaped] += self.least
        out[fresh] += self.least
        return out


class Model:
    """Gram counts per size, the costs of the kept longest grams, whether all grams are kept,
    frequent words and the totals of the base."""

    def __init__(self, levels: list, hits: tuple, whole: bool, words: dict[bytes, int], tokens: int, distinct: int, texts: int, order: int):
        self.levels, self.hits, self.whole = levels, hits, whole
        self.words, self.tokens, self.distinct = words, tokens, distinct
        self.texts, self.order, self.name = texts, order, uuid.uuid4().hex

    def __getstate__(self) -> dict:
        """Tasks need the trie if it is whole, else the costs alone."""
        return self.__dict__ | ({"hits": None} if self.whole else {"levels": None})


class Counts(NamedTuple):
    """Full tables: (word, n); (gram, n) of 1, 2, ... symbols, the longest with its cost (hit);
    the least count of the grams that tasks hold."""

    words: DataFrame
    levels: list[DataFrame]
    least: int


class Costs:
    """log10 probability of each place; NaN where the full tables have to tell."""

    def __init__(self, model: Model):
        self.whole = Trie(model.levels) if model.whole else None
        if not model.whole:
            self.table, self.hits = KeyTable(model.hits[0].astype(np.uint64)), model.hits[1]

    def log10(self, symbols: np.ndarray, places: np.ndarray, longest: np.ndarray) -> np.ndarray:
        if self.whole:
            return self.whole.log10(symbols, places)
        at = self.table.find(longest.astype(np.uint64))
        return np.where(at >= 0, self.hits[np.maximum(at, 0)] if len(self.hits) else 0.0, np.nan)


def _chunks(texts: list[bytes], most: int) -> Iterator[list[int]]:
    """Places of texts that go together, up to `most` bytes or one longer text."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(t)
    if part:
        yield part


def counted(texts: DataFrame, order: int) -> DataFrame:
    """Partial counts of the longest grams (gram) and of the words (word) of `text`."""
    names = ["gram", "word", "n"]

    def batch(gram, word, n) -> pa.RecordBatch:
        arrays = [pa.array(gram, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for rows in batches:
            texts = rows.column(0).to_pylist()
            for text in texts:
                split = text.lower().split()
                words.update(w for w in split if len(w) <= WORD_BYTES)
                long = [w for w in split if len(w) > WORD_BYTES]
                if long:
                    yield batch([None] * len(long), long, [1] * len(long))
                if len(words) > COUNTED_WORDS:
                    yield batch([None] * len(words), list(words), list(words.values()))
                    words.clear()
            for part in _chunks(texts, COUNTED_BYTES):
                new, n = np.unique(grams(*stream([texts[i] for i in part], order), order + 1), return_counts=True)
                every, where = np.unique(np.concatenate((keys, new)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, n)), len(every)).astype(np.int64)
                keys = every
                if len(keys) > NODES:
                    yield batch(keys, [None] * len(keys), counts)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield batch(keys, [None] * len(keys), counts)
        if words:
            yield batch([None] * len(words), list(words), list(words.values()))

    return texts.mapInArrow(run, "gram long, word binary, n long")


def _owner(gram: str | Column) -> Column:
    """The context of a gram: the gram without its last symbol."""
    return F.shiftright(gram, BITS)


def _tail(gram: str, size: int) -> Column:
    """The last `size` symbols of a gram."""
    return F.col(gram).bitwiseAND((1 << (BITS * size)) - 1)


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count from which on no more than `most` rows remain: histograms of the
    counts, each over the cell of the one before in which the limit is passed."""
    low, step, above = 1, HISTOGRAM**2, 0
    while True:
        inside = counts.where((F.col("n") >= low) & (F.col("n") < low + step * HISTOGRAM))
        cells = inside.groupBy(F.floor((F.col("n") - low) / F.lit(step)).alias("cell")).count().collect()
        for cell, rows in sorted(((c, n) for c, n in cells), reverse=True):
            if above + rows > most:
                break
            above += rows
        else:
            return low
        if step == 1:
            return low + cell + 1
        low, step = low + cell * step, step // HISTOGRAM


def fit(docs: DataFrame, order: int = ORDER, nodes: int = NODES, frequent: int = FREQUENT) -> tuple[Model, Counts]:
    """The model and the full tables of the training texts."""
    prepare(docs.sparkSession)
    learnt = docs.where(~held_out("doc_id", FOLDS, HELD_FOLD)).select(raw_bytes("text").alias("text"))
    partial = written(counted(learnt, order), "partial-counts")
    words = partial.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "word-counts")
    # A context has no more than SYMBOLS followers, so its window is small.
    owner = Window.partitionBy("context")
    longest = partial.where("gram IS NOT NULL").select(_owner("gram").alias("context"), "gram", "n").repartition("context")
    longest = longest.groupBy("context", "gram").agg(F.sum("n").alias("n")).select(
        "gram", "n", F.log10(F.col("n") / (F.sum("n").over(owner) + F.count("*").over(owner))).alias("hit")
    )
    longest = written(longest, "gram-counts")
    levels = [longest]
    for size in range(order, 0, -1):
        shorter = levels[0].select(_tail("gram", size).alias("gram"), "n")
        levels.insert(0, written(shorter.groupBy("gram").agg(F.sum("n").alias("n")), f"grams-{size}"))
    every = levels[1].select("n")
    for level in levels[2:]:
        every = every.unionByName(level.select("n"))
    least = _least(every, nodes)
    arrays = []
    for k, level in enumerate(levels):
        kept = level if k == 0 else level.where(F.col("n") >= least)
        table = kept.toArrow()
        keys, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        if k == order:
            hits = keys, table.column("hit").to_numpy().astype(np.float32)
        place = np.argsort(keys)
        arrays.append((keys[place], n[place]))
    texts = int(sum(n for key, n in zip(*arrays[0], strict=True) if key == END))
    some = words.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    short = words.where(F.octet_length("word") <= WORD_BYTES)
    often = short.where(F.col("n") >= _least(short.select("n"), frequent))
    known = {bytes(r.word): r.n for r in often.toLocalIterator()}
    tokens, distinct = (some.n or 0) + texts, some.kinds + (texts > 0)
    model = Model([x for x in arrays if len(x[0])], hits, least == 1, known, tokens, distinct, texts, order)
    return model, Counts(words, levels, least)


SCORED = "row long, n_tokens long, n_known long, base double, score double, word binary, gram long, times long"


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document (times is null), and a row per document and word or longest gram
    that is not among those the tasks hold. `row` numbers the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select("doc_id", raw_bytes("text").alias("text"))
    fields = [x.split() for x in SCORED.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own, words = kept(model.name, lambda: Costs(model)), model.words
        logs = {w: float(np.log10(n + 1)) for w, n in words.items()}
        end = float(np.log10(model.texts + 1))
        row = TaskContext.get().partitionId() << 33
        schema = pa.schema([])

        def some(**columns: pa.Array) -> pa.RecordBatch:
            n = len(columns["row"])
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        for rows in batches:
            schema = pa.schema([("doc_id", rows.schema.field(0).type), *((name, kinds[kind]) for name, kind in fields)])
            texts = rows.column(1).to_pylist()
            scores = np.zeros(len(texts))
            for part in _chunks(texts, SCORED_BYTES):
                symbols, places = stream([texts[i] for i in part], model.order)
                longest = grams(symbols, places, model.order + 1)
                value = own.log10(symbols, places, longest)
                edges = np.cumsum([0, *(len(texts[i]) + 1 for i in part)])
                scores[part] = np.add.reduceat(np.nan_to_num(value), edges[:-1])
                open_ = np.flatnonzero(np.isnan(value))
                if len(open_):
                    cuts = np.searchsorted(open_, edges[1:-1])
                    found = [np.unique(g, return_counts=True) for g in np.split(longest[open_], cuts)]
                    whose = np.repeat(row + np.array(part), [len(g) for g, _ in found])
                    gram, times = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield some(row=pa.array(whose, pa.int64()), gram=pa.array(gram, pa.int64()), times=pa.array(times, pa.int64()))
            out: list[list] = [[] for _ in fields]
            rare: list[list] = [[], [], []]
            for text, score in zip(texts, scores.tolist(), strict=True):
                split = text.lower().split()
                found = [logs[w] for w in split if w in logs]
                if len(found) < len(split):
                    left = Counter([w for w in split if w not in logs])
                    rare[0] += [row] * len(left)
                    rare[1] += left.keys()
                    rare[2] += left.values()
                known = len(found) + (model.texts > 0)
                values = (row, len(split) + 1, known, sum(found) + end, score, None, None, None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                row += 1
            arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *arrays], schema=schema)
            if rare[0]:
                yield some(row=pa.array(rare[0], pa.int64()), word=pa.array(rare[1], pa.binary()), times=pa.array(rare[2], pa.int64()))

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {SCORED}")


def _unseen(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, cost) of distinct longest grams that no training text has, as Trie.log10 does it:
    from the longest known context down, each without the followers of the one before."""
    order = len(levels) - 1
    state = grams.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("above"), F.lit(None).cast("long").alias("excluded"))
    for j in range(order, -1, -1):
        # Tables that the alphabet bounds are broadcast, as many grams meet at few keys there.
        small = F.broadcast if j <= 1 else lambda df: df
        here = state.withColumn("key", _tail("gram", j + 1)).withColumn("context", _owner("key"))
        level = levels[j].select(F.col("gram").alias("key"), "n")
        # Total and kinds of the contexts asked for, and what their followers count one level down.
        asked = small(here.select("context").distinct()) if j <= 1 else here.select("context").distinct()
        followers = level.withColumn("context", _owner("key")).join(asked, "context", "left_semi")
        if j:
            shorter = small(levels[j - 1].select(F.col("gram").alias("short"), F.col("n").alias("less")))
            followers = followers.withColumn("short", _tail("key", j)).join(shorter, "short")
        else:
            followers = followers.withColumn("less", F.lit(0))
        contexts = followers.groupBy("context").agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("less").alias("out")
        )
        here = here.join(small(contexts), "context", "left").join(small(level), "key", "left")
        escaped, met, known = F.col("above").isNotNull(), F.col("n").isNotNull(), F.col("total").isNotNull()
        left = F.col("kinds") - F.col("above")
        rest = F.col("total") - F.col("excluded") + left
        step = (
            F.when(F.col("done"), 0.0)
            .when(escaped & met, F.log10("n") - F.log10(rest))
            .when(escaped & (left > 0), F.log10(left) - F.log10(rest))
            .when(escaped, 0.0)
            .when(met, F.log10(F.col("n") / (F.col("total") + F.col("kinds"))))
            .when(known, F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))))
            .otherwise(0.0)
        )
        state = written(here.select(
            "gram", (F.col("cost") + step).alias("cost"), (F.col("done") | met).alias("done"),
            F.coalesce("kinds", "above").alias("above"), F.coalesce("out", "excluded").alias("excluded"),
        ), f"unseen-{j}")
    least = float(np.log10(1.0 / max(1, SYMBOLS - levels[0].count())))
    return state.select("gram", (F.col("cost") + F.when(F.col("done"), 0.0).otherwise(least)).alias("cost"))


def _joined(rest: DataFrame, counts: Counts) -> DataFrame:
    """(row, cost) of the grams (row, gram, times) that the tasks do not hold."""
    rare = counts.levels[-1].where(F.col("n") < counts.least).select("gram", "hit")
    met = rest.join(rare, "gram", "left").groupBy("row", F.when(F.col("hit").isNull(), F.col("gram")).alias("gram"))
    met = written(met.agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.col("hit")).alias("cost")), "rare-grams")
    never = met.where("gram IS NOT NULL").drop("cost")
    costs = _unseen(never.select("gram").distinct(), counts.levels)
    never = never.join(costs, "gram").select("row", (F.col("times") * F.col("cost")).alias("cost"))
    return met.where("gram IS NULL").select("row", "cost").unionByName(never).groupBy("row").agg(F.sum("cost").alias("cost"))


def score_documents(docs: DataFrame, order: int = ORDER, nodes: int = NODES, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = fit(docs, order, nodes, frequent)
    both = written(_scored(docs, model), "scored")
    per_word = both.where("word IS NOT NULL").select("row", "word", "times")
    words = counts.words
    if model.words:
        words = words.where((F.col("n") < min(model.words.values())) | (F.octet_length("word") > WORD_BYTES))
    met = per_word.join(words.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs")
    )
    out = both.where("times IS NULL").drop("word", "gram", "times").join(met, "row", "left")
    if model.whole:
        out = out.withColumn("cost", F.lit(0.0))
    else:
        rest = both.where("gram IS NOT NULL").select("row", "gram", "times")
        out = out.join(_joined(rest, counts), "row", "left")
    share = float(np.log10(model.tokens + model.distinct + 1))
    return out.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_FOLD).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        (F.col("score") + F.coalesce("cost", F.lit(0.0))).alias("score"),
    )
