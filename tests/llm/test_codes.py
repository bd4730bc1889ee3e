from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import codes
from orderlens.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, code string, error double, _salt int"


def plain(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label), all taking part. The contract in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min((gap(part, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cut:
                members[nearest(v[p], books[p])[1]].append(v[p])
            for e, m in members.items():
                books[p][e] = tuple(sum(x) // len(m) for x in zip(*m, strict=True))
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{e:02x}" for _, e in f), d, by_label[r[2]], digest)
         for r, f, d in zip(rows, found, errors, strict=True)), key=repr,
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 20), st.integers(1, 4), st.sampled_from([2, 5, 1000]))
def test_search_finds_the_nearest_entry(seed, rows, entries, width, spread):
    random = np.random.default_rng(seed)
    books = codes.codebooks(random.integers(-spread, spread, (3, entries, width)))
    points = random.integers(-spread, spread, (rows, 3, width))
    entry, distance = codes.orchard(points, books)
    gaps = np.square(points[:, :, None] - books.entries[None]).sum(-1)
    assert (entry == gaps.argmin(2)).all() and (distance == gaps.min(2)).all()


def test_search_measures_few_entries_of_clustered_books():
    """The walk stops early: entries further than twice the distance are never taken up."""
    book = np.array([[[1000 * i, 0] for i in range(64)]])
    books = codes.codebooks(book)
    walked = books.reach[0, 0] <= 1  # a point at distance 1 of entry 0
    assert walked.sum() == 1
    assert codes.orchard(np.array([[[1, 0]]]), books) == (np.array([[0]]), np.array([[1]]))


def test_given_vectors(spark):
    given = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in given.collect()]
    assert rows_of(codes.encode_vectors(given)) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vector = lambda i: [((i * 7 + k * 3) % 11 - 5) / 16 for k in range(32)]
    good = [(i, vector(i), i % 3 if i % 5 else None) for i in range(40)]
    good += [(3, vector(3), 0), (3, vector(3), 0), (3, vector(9), 1), (None, vector(4), None), (-7, vector(5), 2)]
    good += [(100 + i, vector(1), 1) for i in range(70)]
    bad = [
        (50, None, 1), (51, [None] * 32, 1), (52, [nan, *vector(1)[1:]], 1), (53, [inf, *vector(1)[1:]], 1),
        (54, [0.5] * 16, 1), (55, [0.5] * 33, 1), (56, [], 1), (57, [3e38, *vector(1)[1:]], 1), (-99, [0.5] * 5, 0),
    ]
    df = spark.createDataFrame([(*r, "k", "c", 0.5, 1) for r in [*good, *bad]], SCHEMA).repartition(3)
    want = plain([(i, [float(np.float32(x)) for x in v], label) for i, v, label in good])
    assert rows_of(codes.encode_vectors(df)) == want


def test_many_labels_are_joined_salted(spark):
    coded = spark.createDataFrame(
        [(i, None if i % 7 == 0 else i % 5, "00", i) for i in range(200)], "key long, label int, code string, error long"
    )
    sort = lambda df: sorted((tuple(r) for r in df.select("key", "label", "error", "label_error").collect()), key=repr)
    assert sort(codes.with_label_error(coded, label_rows=2)) == sort(codes.with_label_error(coded))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.encode_vectors(empty).columns == columns
    assert codes.encode_vectors(empty).collect() == []
    only_bad = spark.createDataFrame([(1, None, 1, "", "", 0.0, 0), (2, [1.0], 1, "", "", 0.0, 0)], SCHEMA)
    assert codes.encode_vectors(only_bad).collect() == []
    with pytest.raises(ValueError):
        codes.encode_vectors(empty, entries=257)
