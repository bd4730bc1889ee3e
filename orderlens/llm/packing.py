"""Documents packed into training sequences by vector best fit.

Texts become token ids by the public tokenizer file, closed with a separator id. Only
documents longer than a sequence are cut. Pieces are dealt over shards of a bounded
number of pieces by their row number; within a shard they are placed from the longest to
the shortest. A sequence has three capacities: tokens, number of documents and attention
cost (the sum of squared piece lengths). Of all open sequences in which a piece fits under
every capacity, best fit takes the one with the largest weighted dot product of demand
and residual, or the one with the smallest weighted norm of the residual it would leave.

With the production limits the two further capacities cannot forbid what the tokens allow
(a sequence of n tokens holds at most n documents and costs at most n squared), so they only
steer; tighter limits are parameters.

Defined cases: null or empty texts are the separator alone, one piece of length 1; rows that
repeat a doc_id are packed each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import kept, prepare, raw_bytes, written

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0
SHARD_PIECES = 8_192
CACHED_CHUNKS = 400_000
CACHED_PARTS = 400_000
# Longer chunks and parts are encoded each time: without spaces a chunk is a whole document.
CACHED_BYTES = 256
# Here with ids of documents that are long; other types stay as they are.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Chunks of these characters are cut without the library: printable ASCII and the letters and
# signs up to U+017F, for which lower-casing and composing work character by character.
_PLAIN = re.compile("[!-~¡-įı-ſ]+")
_LETTER = "a-zªµºß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"
_NUMBER = "0-9²³¹¼-¾"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer never joins characters across ASCII white space, so a text's ids are those
    of its chunks one after another, and repeated chunks are looked up. Anything unusual
    goes through the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in visible}
        letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
        self.letters = [letters[b] for b in range(256)]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(part) <= CACHED_BYTES:
                if len(self.parts) >= CACHED_PARTS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters only
            return self._part(chunk.lower().decode())
        text = chunk.decode()
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self._part(part) for part in _PART.findall(text.lower())])

    def ids(self, text: bytes) -> bytes:
        words = text.split()
        chunks = self.chunks
        try:
            return b"".join([chunks[w] for w in words])
        except KeyError:
            return b"".join([self._cached(w) for w in words])

    def _cached(self, chunk: bytes) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
            if len(chunk) <= CACHED_BYTES:
                if len(self.chunks) >= CACHED_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return kept(path, lambda: Encoder(path))


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids cut into pieces of at most `capacity`: PIECES."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        close = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + close
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                doc, *rest = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(doc), *rest], names)

    frame = docs.select("doc_id", raw_bytes("text").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(cut, PIECES.replace("doc_id long", f"doc_id {kind}"))


def pack(lengths: np.ndarray, capacity: int = CAPACITY, max_documents: int | None = None,
         max_attention: int | None = None, criterion: str = "norm",
         weights: tuple[float, float, float] = (1.0, 0.01, 0.1)) -> np.ndarray:
    """The bin of each piece; pieces of equal length are placed in the order given."""
    most_documents, most_attention = max_documents or capacity, max_attention or capacity * capacity
    lengths = np.asarray(lengths, np.int64)
    longest = int(lengths.max(initial=0))
    if longest > capacity or longest**2 > most_attention:
        raise ValueError("a piece exceeds the capacity of a sequence")
    by_tokens, by_documents, by_attention = np.asarray(weights) / np.square(
        [float(capacity), float(most_documents), float(most_attention)]
    )
    size = max(1, len(lengths))
    tokens, documents, attention = (np.empty(size, np.int64) for _ in range(3))
    name, out = np.empty(size, np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min(initial=capacity))
    n_open = bins = closed = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fits = np.flatnonzero(tokens[:n_open] >= need)
        left = attention[fits] - need * need
        allowed = (left >= 0) & (documents[fits] >= 1)
        if not allowed.all():
            fits, left = fits[allowed], left[allowed]
        if len(fits):
            rest_tokens, rest_documents = tokens[fits], documents[fits]
            if criterion == "dot":
                score = by_tokens * need * rest_tokens + by_documents * rest_documents
                score += by_attention * need * need * (left + need * need)
                best = fits[np.argmax(score)]
            else:
                score = by_tokens * np.square(rest_tokens - need, dtype=float)
                score += by_documents * np.square(rest_documents - 1, dtype=float)
                score += by_attention * np.square(left, dtype=float)
                best = fits[np.argmin(score)]
        else:
            best = n_open
            tokens[best], documents[best], attention[best] = capacity, most_documents, most_attention
            name[best] = bins
            n_open, bins = n_open + 1, bins + 1
        tokens[best] -= need
        documents[best] -= 1
        attention[best] -= need * need
        out[i] = name[best]
        if tokens[best] < least or documents[best] < 1:
            tokens[best] = -1  # closed; taken out when some have gathered
            closed += 1
            if closed > 64 or best == n_open - 1:
                live = np.flatnonzero(tokens[:n_open] >= 0)
                for x in (tokens, documents, attention, name):
                    x[: len(live)] = x[live]
                n_open, closed = len(live), 0
    return out


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, **options) -> DataFrame:
    """`pieces` with sequence_id and offset; shards of at most some `shard_pieces` pieces."""
    pieces = written(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))

    def place(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("_row")
        length = shard.column("length").to_numpy()
        bins = pack(length, capacity, **options)
        # Within a bin pieces lie in the order of the rows.
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        begin = ends - length[order]
        offset = np.empty(len(bins), np.int64)
        offset[order] = begin - np.repeat(begin[first], np.diff(np.append(first, len(bins))))
        sequence = (shard.column("_shard").to_numpy() << 32) + bins
        shard = shard.drop_columns(["_row", "_shard"])
        return shard.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.groupBy("_shard").applyInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    prepare(docs.sparkSession)
    return best_fit(token_pieces(docs, tokenizer))
