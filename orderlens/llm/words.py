"""Words as byte matrices and a table of 64-bit keys, for models that numpy scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Words longer than this are scored in parts of this length.
LONGEST = 64
# Words of one length go to numpy in matrices of at most this size.
MATRIX_BYTES = 1 << 19
_SPACES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and of characters beyond ASCII."""
    return text.lower().encode().translate(_SPACES).split() if text else []


def short_words(text: str | None) -> list[bytes]:
    """words_of, with longer words in parts of LONGEST bytes."""
    words = words_of(text)
    if words and max(map(len, words)) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def by_length(words: list[bytes], most_bytes: int = MATRIX_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `words`, byte matrix) for every length that occurs, in matrices of at most some
    `most_bytes` bytes; words are not empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = max(1, most_bytes // int(sizes[order[a]]))
        for c in range(a, b, rows):
            at = order[c : min(b, c + rows)]
            yield at, np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), -1)


class KeyTable:
    """Places of 64-bit keys by open addressing; a key that is not there has place -1."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(1.4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.places[slot] < 0
            # Of several keys at one slot the last one written stays; the others go on.
            self.places[slot[free]] = todo[free]
            won = self.places[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.places[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            here = self.places[slot]
            out[todo] = here
            on = (here >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[on], slot[on]
        return out
