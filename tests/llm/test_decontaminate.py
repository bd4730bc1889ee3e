from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from orderlens.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=d.WIDTH):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i : i + n]))
                if owners is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in owners if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted(map(tuple, d.digest(d.decontaminate(docs, items, **options)).collect()), key=repr)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog while seven"), (2, "One two, THREE"), (3, None), (4, "..."),
        (5, "élan"), (2, "One two, THREE"), (None, "other text of the same id"), (10, "a"), (6, "x" * 20_000),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("shard", [1, 50_000, 1 << 24])
def test_odd_rows(odd, benchmark, shard):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [tuple(r) for r in benchmark.collect()]
    assert found(odd, benchmark, shard_bytes=shard) == brute(docs, items)


def test_slices_of_the_benchmark_add_up(odd, benchmark):
    assert found(odd, benchmark, slice_words=700) == found(odd, benchmark)


def test_random_streams(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices(["a", "b", "B", "c!", "é", "zz"], k=rnd.randint(0, 60)))) for i in range(120)]
    items = [(i, " ".join(rnd.choices(["a", "b", "c", "é"], k=rnd.randint(0, 7)))) for i in range(30)]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    assert found(left, right, width=5) == brute(docs, items, 5)


def test_empty_tables(odd, nothing, benchmark):
    assert found(nothing, benchmark) == []
    rows = found(odd, benchmark.limit(0))
    assert len(rows) == 16 and not any(r[-1] for r in rows)


def test_index_against_counting():
    rnd = np.random.default_rng(4)
    stream = rnd.integers(0, 4, 500)
    stream[-1] = 0
    index = d.FMIndex(stream.astype(np.int64), 4)
    for pattern in ([1], [2, 3], [1, 1, 2], [3, 3, 3, 3, 3, 3]):
        padded = np.array([[0] * (6 - len(pattern)) + pattern])
        low, high = index.search(padded, np.array([len(pattern)]))
        want = [i for i in range(500) if stream[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_removal(odd, benchmark):
    clean = d.clean_documents(odd, benchmark)
    assert clean.columns == odd.columns
    items = [tuple(r) for r in benchmark.collect()]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [r for r in rows if not brute([r], items)[0][-1]]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(want, key=repr)
    assert d.without_spans("Keep, this: One  two-three! é end", [(2, 5)]) == "Keep, this: ! é end"
    assert d.merged([(5, 7), (1, 3), (2, 4), (7, 9)]) == [(1, 4), (5, 9)]
