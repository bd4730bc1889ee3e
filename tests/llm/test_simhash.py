from __future__ import annotations

import random
import re

import pytest
from xxhash import xxh64_intdigest

from orderlens.llm import simhash
from orderlens.llm.common import table


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints):
    """Smallest reachable id of each (id, print); null ids are never the smallest."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(doc, known)
    return [least[find(i)] for i in range(len(prints))]


def check(df, rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, groups(prints), strict=True)]
    got = map(tuple, simhash.digest(simhash.near_duplicates(df)).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_rows(odd, nothing):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.digest(simhash.near_duplicates(nothing)).collect() == []


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def clouds(seed):
    """Fingerprints in dense clouds, chains and at random, with the two top bits in use."""
    rnd = random.Random(seed)
    out = {rnd.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        weak = rnd.sample(range(64), 8)
        out |= {centre ^ sum(1 << b for b in weak if rnd.random() < 0.4) for _ in range(60)}
        for _ in range(20):  # a chain of steps of one or two bits
            centre ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 2)))
            out.add(centre)
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("bucket", [2, 10, 512])
def test_links_lose_no_pair_and_repeat_none(spark, bucket):
    prints = clouds(bucket)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    pairs = [tuple(r) for r in simhash.links(df, bucket).collect()]
    want = {
        (min(a, b), max(a, b)) for i, a in enumerate(prints) for b in prints[:i]
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    }
    assert len(want) > 100 and len(pairs) == len(set(pairs)) and set(pairs) == want


def test_variants_are_never_broadcast(spark, monkeypatch):
    plans, write = [], simhash.written
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "written", lambda df, label: planned(df) or write(df, label))
    df = spark.createDataFrame([(p,) for p in clouds(7)], "fp long")
    planned(simhash.links(df, 10))
    assert all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in plans)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(-5, 300), (300, 301), (-5, 300)]
    edges = [(min(e), max(e)) for e in edges]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in simhash.components(df).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)},
                     **{200 + i: 200 for i in range(1, 9)}, 300: -5, 301: -5}


def test_one_of_each_group_stays(odd):
    kept = simhash.without_near_copies(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    component = groups([(i, plain_print(t)) for i, t in rows])
    want = {(i, t) for (i, t), c in zip(rows, component, strict=True) if i == c}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_columns_of_the_caller_stay(odd):
    names = ["_id", "_tag", "_own", "id", "row", "fp", "_text", "text_sha256", "component_id"]
    kept = simhash.without_near_copies(odd.selectExpr("*", *(f"kind || '{n}' AS `{n}`" for n in names)))
    assert kept.columns == [*odd.columns, *names]
    assert all(r[n] == "kind" + n for r in kept.collect() for n in names)
