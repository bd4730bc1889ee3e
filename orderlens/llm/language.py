"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed: all pieces of a public tokenizer, and all single bytes. Each language
has a probability per piece. The probability of a word (with its space before it) is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over
its words. Piece probabilities come from expectation maximisation on word counts of a bounded
sample per language (SAMPLE_ROWS rows, SAMPLE_BYTES bytes): Spark runs the forward and
backward pass over partitions of words and adds up the expected piece counts, at most
vocabulary times languages of them.

All words of one length are scored together in numpy, in matrices of bounded size. A word of
more than LONGEST bytes is first cut where no piece of the vocabulary crosses, which leaves its
sum a product of its parts' sums; a part that is still longer goes through the forward
algorithm byte by byte, in memory that does not depend on its length. Such parts teach nothing.

Defined cases: text that is null or has no letter is `und` with score 0; so is every text if
nothing can be learnt; a null lang or doc_id teaches nothing; ties go to the first language in
alphabetical order; rows that repeat a doc_id are scored each for itself; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import held_out, kept, prepare, written
from orderlens.llm.words import LONGEST, KeyTable, by_length, words_of

VOCABULARY = "piece_bpe_32k.model"
# Bytes of a piece that are looked up as one integer; the rest is compared.
HEAD = 8
SAMPLE_ROWS = 800
SAMPLE_BYTES = 4 << 20
WORDS_PER_TASK = 20_000
ROUNDS = 3
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"
# Expected count that every piece has in every language beforehand.
PRIOR_COUNT = 0.05
CACHED_WORDS = 300_000
TEXT_WORDS = 500_000
LATTICE_BYTES = 1 << 20
WINDOW = 1 << 16
# First byte of the name of a word's part; whole words are named by their own bytes.
PART = b"\0"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> list[bytes]:
    """The pieces as bytes. The mark of a word's beginning is a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(1, 256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(p for p in pieces if p)


class Pieces:
    """Finds the pieces of a vocabulary, of any length, in rows of bytes.

    Up to HEAD bytes a piece is its bytes as one integer. Longer pieces are looked up by
    their first HEAD bytes, and the rest of every piece with that head is compared.
    """

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces), default=1)
        short = [i for i, p in enumerate(pieces) if len(p) <= HEAD]
        self.short = KeyTable(np.array([int.from_bytes(pieces[i], "big") for i in short], np.uint64))
        self.place = np.array([*short, -1], np.int32)
        longer = sorted((p, i) for i, p in enumerate(pieces) if len(p) > HEAD)
        heads = Counter(p[:HEAD] for p, _ in longer)
        self.heads = KeyTable(np.array([int.from_bytes(h, "big") for h in heads], np.uint64))
        self.members = np.array(list(heads.values()), np.int64)
        self.first = np.cumsum(self.members) - self.members
        self.sizes = np.array([len(p) for p, _ in longer], np.int64)
        self.places = np.array([i for _, i in longer], np.int32)
        rests = b"".join(p[HEAD:].ljust(self.longest - HEAD, b"\0") for p, _ in longer)
        self.rests = np.frombuffer(rests, np.uint8).reshape(len(longer), -1) if longer else None

    def within(self, rows: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        """The pieces inside every row. The first result has, for k + 1 up to HEAD bytes, the
        place of the piece that begins at byte i of each row, or -1; the second the row, begin,
        size and place of every longer one."""
        n, width = rows.shape
        wide = rows.astype(np.uint64)
        short, key = [], np.zeros((n, width + 1), np.uint64)
        for k in range(min(HEAD, width)):
            key = (key[:, : width - k] << np.uint64(8)) | wide[:, k:]
            short.append(self.place[self.short.find(key.ravel())].reshape(key.shape))
        nothing = np.empty(0, np.int64)
        if width <= HEAD or self.rests is None:
            return short, (nothing,) * 4
        head = self.heads.find(key.ravel()).reshape(key.shape)
        row, begin = np.nonzero(head >= 0)
        head = head[row, begin]
        times = self.members[head]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        piece = np.repeat(self.first[head], times) + nth
        row, begin = np.repeat(row, times), np.repeat(begin, times)
        inside = begin + self.sizes[piece] <= width
        row, begin, piece = row[inside], begin[inside], piece[inside]
        size, offset = self.sizes[piece], np.arange(self.rests.shape[1])
        there = rows[row[:, None], np.minimum(begin[:, None] + HEAD + offset, width - 1)]
        same = ((there == self.rests[piece]) | (offset >= (size - HEAD)[:, None])).all(1)
        return short, (row[same], begin[same], size[same], self.places[piece[same]])

    def arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, size and place of all pieces in one word, by begin."""
        short, (_, begin, size, place) = self.within(np.frombuffer(word, np.uint8)[None, :])
        begins = [np.flatnonzero(found[0] >= 0) for found in short]
        sizes = [np.full(len(b), k + 1) for k, b in enumerate(begins)]
        places = [found[0][b] for found, b in zip(short, begins, strict=True)]
        arcs = [np.concatenate(x) for x in ((*begins, begin), (*sizes, size), (*places, place))]
        order = np.argsort(arcs[0], kind="stable")
        return arcs[0][order], arcs[1][order], arcs[2][order]

    def parts(self, word: bytes, window: int = WINDOW) -> Iterator[list[bytes]]:
        """`word` cut wherever no piece crosses, some parts at a time."""
        first, depth, rest = 0, 0, np.zeros(self.longest + 1, np.int64)
        for at in range(0, len(word), window):
            begin, size, _ = self.arcs(word[at : at + window + self.longest - 1])
            begin, size = begin[begin < window], size[begin < window]
            # A piece crosses the places from the one after its first byte to its last byte.
            change = np.zeros(window + self.longest + 1, np.int64)
            change[: len(rest)] = rest
            np.add.at(change, begin + 1, 1)
            np.add.at(change, begin + size, -1)
            crossed = depth + np.cumsum(change[:window])
            depth, rest = crossed[-1], change[window:]
            cuts = (at + np.flatnonzero(crossed == 0)).tolist()
            edges = [first, *(c for c in cuts if first < c < len(word))]
            yield [word[a:b] for a, b in pairwise(edges)]
            first = edges[-1]
        yield [word[first:]]


class Lattice:
    """Forward and backward sums of rows of bytes of one length over all segmentations."""

    def __init__(self, pieces: Pieces, rows: np.ndarray):
        self.n, self.size = rows.shape
        short, (row, begin, size, place) = pieces.within(rows)
        # (rows, begin, end, places) of all arcs of one begin and end
        self.arcs = [
            (slice(None), i, i + k + 1, found[:, i]) for k, found in enumerate(short) for i in range(found.shape[1])
        ]
        order = np.lexsort((size, begin))
        row, begin, size, place = row[order], begin[order], size[order], place[order]
        edges = np.flatnonzero(np.diff(begin * (pieces.longest + 1) + size, prepend=-1, append=-1))
        self.arcs += [
            (row[a:b], int(begin[a]), int(begin[a] + size[a]), place[a:b]) for a, b in pairwise(edges.tolist())
        ]

    def forward(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each place, each scaled by its largest, and the logs of the scales.
        `odds` has a row per piece and a last row of zeros for no piece."""
        sums = np.zeros((self.size + 1, self.n, odds.shape[1]))
        logs = np.zeros((self.size + 1, self.n))
        sums[0] = 1.0
        to: list[list] = [[] for _ in range(self.size + 1)]
        for arc in self.arcs:
            to[arc[2]].append(arc)
        for j in range(1, self.size + 1):
            for row, i, _, place in to[j]:
                shift = np.exp(logs[i, row] - logs[j - 1, row])[:, None]
                sums[j, row] += sums[i, row] * odds[place] * shift
            top = sums[j].max(1)
            sums[j] /= top[:, None]
            logs[j] = logs[j - 1] + np.log(top)
        return sums, logs

    def log_odds(self, odds: np.ndarray) -> np.ndarray:
        sums, logs = self.forward(odds)
        return np.log(np.maximum(sums[-1], 1e-300)) + logs[-1][:, None]

    def expected(self, odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece per language, over words that occur `counts` times."""
        sums, logs = self.forward(odds)
        after = np.zeros_like(sums)
        back = np.zeros_like(logs)
        after[-1] = 1.0
        total = np.maximum(sums[-1], 1e-300)
        places, uses = [], []
        out_of: list[list] = [[] for _ in range(self.size)]
        for arc in self.arcs:
            out_of[arc[1]].append(arc)
        for i in range(self.size - 1, -1, -1):
            for row, _, j, place in out_of[i]:
                step = odds[place] * after[j, row]
                after[i, row] += step * np.exp(back[j, row] - back[i + 1, row])[:, None]
                weight = np.exp(logs[i, row] + back[j, row] - logs[-1, row])[:, None]
                places.append(place)
                uses.append(sums[i, row] * step * weight / total[row] * counts[row])
            top = np.maximum(after[i].max(1), 1e-300)
            after[i] /= top[:, None]
            back[i] = back[i + 1] + np.log(top)
        place, used = np.concatenate(places) % len(odds), np.concatenate(uses)
        return np.stack([np.bincount(place, used[:, x], len(odds)) for x in range(odds.shape[1])], 1)


def lattices(pieces: Pieces, names: list[bytes], languages: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(places in `names`, their lattice): whole words get their mark, parts are taken as they are."""
    for parts in (False, True):
        at = np.array([i for i, name in enumerate(names) if name.startswith(PART) == parts], np.int64)
        for places, matrix in by_length([names[i] for i in at], LATTICE_BYTES // max(1, languages)):
            rows = matrix[:, 1:]
            if not parts:
                rows = np.empty((len(matrix), matrix.shape[1] + 1), np.uint8)
                rows[:, 0], rows[:, 1:] = 0x20, matrix
            yield at[places], Lattice(pieces, rows)


class Model:
    """Languages, pieces and their probabilities (a row per piece, a column per language)."""

    def __init__(self, languages: list[str], pieces: list[bytes], odds: np.ndarray):
        self.languages, self.pieces, self.odds = languages, pieces, odds
        self.name = uuid.uuid4().hex


class Scorer:
    def __init__(self, model: Model):
        self.languages = model.languages
        self.pieces = Pieces(model.pieces)
        self.odds = np.vstack((model.odds, np.zeros(len(model.languages))))
        self.words: dict[bytes, int] = {}
        self.logs = np.empty((0, len(model.languages)))

    def make_room(self) -> None:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
            self.logs = self.logs[:0]

    def learn(self, names: set[bytes]) -> None:
        new = [w for w in names if w not in self.words]
        if not new:
            return
        logs = np.empty((len(new), len(self.languages)))
        for at, lattice in lattices(self.pieces, new, len(self.languages)):
            logs[at] = lattice.log_odds(self.odds)
        self.words.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate((self.logs, logs))

    def total(self, names: list[bytes]) -> np.ndarray:
        """Log-odds of words and parts together."""
        out = np.zeros(len(self.languages))
        for a in range(0, len(names), TEXT_WORDS):
            some = names[a : a + TEXT_WORDS]
            if not all(map(self.words.__contains__, some)):
                self.make_room()
                self.learn(set(some))
            out += self.logs[np.fromiter(map(self.words.__getitem__, some), np.int64, len(some))].sum(0)
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """Log-odds of a word of any length."""
        out = np.zeros(len(self.languages))
        for parts in self.pieces.parts(b" " + word):
            out += self.total([PART + p for p in parts if len(p) <= LONGEST])
            for p in parts:
                if len(p) > LONGEST:
                    out += self.stretched(p)
        return out

    def stretched(self, part: bytes, window: int = WINDOW) -> np.ndarray:
        """Log-odds of one part, byte by byte; the sums ahead are kept relative to the present one."""
        reach, out = self.pieces.longest, np.zeros(len(self.languages))
        ahead = np.zeros((window + reach + 1, len(self.languages)))
        ahead[0] = 1.0
        for at in range(0, len(part), window):
            begin, size, place = self.pieces.arcs(part[at : at + window + reach - 1])
            stop = min(window, len(part) - at)
            edges = np.searchsorted(begin, np.arange(stop + 1))
            for i, (a, b) in enumerate(pairwise(edges.tolist())):
                out += np.log(ahead[i])
                ahead[i + 1 : i + reach + 1] /= ahead[i]
                ahead[i + size[a:b]] += self.odds[place[a:b]]
            ahead[: reach + 1] = ahead[stop : stop + reach + 1].copy()
            ahead[reach + 1 :] = 0.0
        return out + np.log(ahead[0])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) for t in texts]
        long = [[w for w in words if len(w) > LONGEST] for words in split]
        usual = [[w for w in words if len(w) <= LONGEST] if far else words for words, far in zip(split, long, strict=True)]
        ends = np.cumsum([len(words) for words in usual])
        names, scores = [], np.zeros(len(texts))
        for k, words in enumerate(split):
            # New words are learnt for as many texts at once as hold TEXT_WORDS words.
            if k == 0 or ends[k] > upto:
                upto = (ends[k - 1] if k else 0) + TEXT_WORDS
                ahead = int(np.searchsorted(ends, upto, "right"))
                self.make_room()
                self.learn(set().union(*usual[k:ahead]))
            if not words or not has_letter(texts[k], words):
                names.append(UNKNOWN)
                continue
            total = self.total(usual[k])
            for w in long[k]:
                total += self.long_word(w)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            names.append(self.languages[best])
            scores[k] = odds[best] / odds.sum()
        return names, scores


def has_letter(text: str, words: list[bytes]) -> bool:
    return any(97 <= w[0] <= 122 for w in words) or any(c.isalpha() for c in text)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text) of a bounded part of the learnable rows, by a hash of the id."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.where(~held_out("doc_id", FOLDS, HELD_FOLD)).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    rate = F.least(rows / F.col("n"), most_bytes / F.greatest(F.col("size"), F.lit(1)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rates = sizes.select("lang", rate.alias("rate"))
    return known.join(F.broadcast(rates), "lang").where(place < F.col("rate")).select("lang", "text")


def fit(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation of the piece probabilities of every language."""
    spark = prepare(docs.sparkSession)
    whole = vocabulary(path or vocabulary_path())
    known = spark.sparkContext.broadcast(whole)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(known.value)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen = Counter(words_of(text))
                for w in [w for w in seen if len(w) > LONGEST]:
                    times = seen.pop(w)
                    for parts in pieces.parts(b" " + w):
                        for p in parts:
                            if len(p) <= LONGEST:
                                seen[PART + p] += times
                if seen:
                    yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})

    words = sample(docs).mapInPandas(split, "lang string, word binary, n long")
    counts = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    spread = counts.repartition(max(1, -(-counts.count() // WORDS_PER_TASK)), "word")
    odds = np.full((len(whole), len(languages)), 1.0 / len(whole))
    number = {x: i for i, x in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(odds)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, odds = Pieces(known.value), shared.value
            full = np.vstack((odds, np.zeros(odds.shape[1])))
            total = np.zeros(full.shape)
            for batch in batches:
                row = {w: i for i, w in enumerate(dict.fromkeys(batch["word"]))}
                seen = np.zeros((len(row), odds.shape[1]))
                at = [row[w] for w in batch["word"]], [number[x] for x in batch["lang"]]
                np.add.at(seen, at, batch["n"].to_numpy(float))
                for places, lattice in lattices(pieces, list(row), odds.shape[1]):
                    total += lattice.expected(full, seen[places])
            piece, lang = np.nonzero(total[:-1])
            yield pd.DataFrame({"piece": piece, "lang": lang, "uses": total[piece, lang]})

        found = spread.mapInPandas(expect, "piece long, lang long, uses double")
        uses = np.full(odds.shape, PRIOR_COUNT)
        for r in found.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r.piece, r.lang] += r.uses
        odds = uses / uses.sum(0)
    return Model(languages, whole, odds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        own = kept(model.name, lambda: Scorer(model))
        for texts in batches:
            if not own.languages:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            names, scores = own.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select("doc_id", run("text").alias("_out")).select("doc_id", "_out.*")


def identify(docs: DataFrame) -> DataFrame:
    """The columns of the contract, with a model learnt from the rows not held out."""
    held = held_out("doc_id", FOLDS, HELD_FOLD).alias("held_out")
    return predict(docs, fit(docs)).select("doc_id", held, "lang_pred", "score")
