from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from orderlens.plans.corpus import COLUMNS
from orderlens.retrieval.index import (
    bucket_of, build_index, corpus_fingerprint, default_stop_words, reuse_or_build,
)
from orderlens.retrieval.search import (
    block_reach, block_scores, candidates, in_folders, one_per_entity, pick_diverse, query_weights,
    retrieve, retrieve_one,
)
from orderlens.retrieval.summary import NOTHING_FOUND, answer
from orderlens.session import new_work_dir, written
from orderlens.sources.store import path_exists

STOP = ["about", "for", "and"]
TEXTS = [
    "delivery delay and complaint about order",
    "invoice for normal order processing",
    "credit memo issued for damaged goods",
    "normal email about project status",
    "urgent complaint about late delivery",
]


def rows():
    kinds = ["email", "document", "document", "email", "email"]
    made = []
    for i in range(20):
        text = TEXTS[i % 5] + (f" note {i}" if i >= 10 else "")
        made.append(
            {
                "doc_id": f"cit_{i:02d}", "entity_type": kinds[i % 5], "entity_id": f"e{i}",
                "customer_id": f"C{i % 3}", "order_id": f"000000000{i % 5}" if i < 18 else None,
                "document_type": "t", "event_date": None, "title": f"Title {i}", "text": text,
                "citation": f"cit_{i:02d}",
            }
        )
    return made


def corpus_of(spark, made):
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in made], schema)


@pytest.fixture(scope="module")
def index(spark):
    return build_index(corpus_of(spark, rows()), new_work_dir(spark, "ix"), STOP)


def terms(text):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def model(made):
    counts = [terms(r["text"]) for r in made]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(made)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(c):
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    return [vector(c) for c in counts], vector


def expected(made, query, k):
    vectors, vector = model(made)
    q = vector(terms(query))
    dot = lambda a, b: sum(x * b.get(t, 0.0) for t, x in a.items())
    scores = [round(dot(q, v), 9) for v in vectors]
    ranked = sorted(range(len(made)), key=lambda i: (-scores[i], made[i]["doc_id"]))[: 4 * k]
    picked = []
    while ranked and len(picked) < k:
        value = lambda i: round(
            0.7 * scores[i] - 0.3 * max((dot(vectors[i], vectors[j]) for j in picked), default=0), 9
        )
        best = max(ranked, key=lambda i: (value(i), -ranked.index(i)))
        picked.append(best)
        ranked.remove(best)
    order = sorted(picked, key=lambda i: (-scores[i], picked.index(i)))
    seen, kept = set(), []
    for i in order:
        entity = (made[i]["entity_type"], made[i]["order_id"])
        if entity not in seen:
            seen.add(entity)
            kept.append((made[i]["doc_id"], round(scores[i], 6)))
    return kept


def found(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


def test_retrieve_equals_brute_force(spark, index):
    made = rows()
    questions = ["complaint about late delivery", "invoice order", "nothing matches", "damaged goods credit memo"]
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "query_id string, query string")
    got = retrieve(asked, index, top_k=3, stop_words=STOP)
    for i, question in enumerate(questions):
        assert found(got.where(f"query_id = '{i}'")) == expected(made, question, 3), question


def test_a_named_order_narrows_the_search(spark, index):
    got = retrieve_one("what about 0000000002 and complaint", index, stop_words=STOP).collect()
    assert {r["order_id"] for r in got} == {"0000000002"}
    unknown = retrieve_one("complaint 9999999999", index, stop_words=STOP).collect()
    assert len({r["order_id"] for r in unknown}) > 1


def test_filters(spark, index):
    got = retrieve_one("complaint", index, stop_words=STOP, filters={"customer_id": "C1", "order_id": "", "x": 1})
    assert {r["customer_id"] for r in got.collect()} == {"C1"}
    none = retrieve_one("complaint", index, stop_words=STOP, filters={"customer_id": "nobody"})
    assert none.count() == 0


def test_many_copies_fill_the_pool_like_separate_rows(spark):
    made = [dict(rows()[0]) for _ in range(30)] + rows()[1:]
    ix = build_index(corpus_of(spark, made), new_work_dir(spark, "copies"), STOP)
    assert ix.docs.count() == 20 and ix.docs.agg({"copies": "sum"}).first()[0] == 49
    asked = spark.createDataFrame([("q", "delivery delay")], "query_id string, query string")
    pool = candidates(asked, ix, STOP, 8).collect()
    assert [r["doc_id"] for r in sorted(pool, key=lambda r: r["position"])] == ["cit_00"] * 8


def test_vocabulary_cap(spark):
    ix = build_index(corpus_of(spark, rows()), new_work_dir(spark, "cap"), STOP, size=3)
    totals = Counter()
    for r in rows():
        totals.update(terms(r["text"]))
    top = sorted(totals.items(), key=lambda e: (-e[1], e[0]))[:3]
    assert sorted((r["term"], r["total"]) for r in ix.vocabulary.collect()) == sorted(top)


def test_one_per_entity(spark):
    df = spark.createDataFrame(
        [("q", "email", "o1", 0.9, 1), ("q", "email", "o1", 0.5, 2), ("q", "document", "o2", 0.8, 3),
         ("q", "customer", None, 0.3, 4), ("q", "customer", None, 0.2, 5)],
        "query_id string, entity_type string, order_id string, score double, pick int",
    )
    assert sorted(r["score"] for r in one_per_entity(df).collect()) == [0.3, 0.8, 0.9]


def test_pick_diverse(spark):
    alike = [[1.0] * 5] * 5
    apart = [[float(i == j) for j in range(4)] for i in range(4)]
    df = spark.createDataFrame(
        [("same", [(s, a) for s, a in zip([0.9, 0.8, 0.7, 0.6, 0.5], alike)]),
         ("apart", [(s, a) for s, a in zip([0.5, 0.5, 0.1, 0.4], apart)]), ("one", [(0.0, [1.0])]), ("none", [])],
        "name string, rows array<struct<score: double, alike: array<double>>>",
    )
    got = {r["name"]: r["p"] for r in df.where("size(rows) > 0").select("name", pick_diverse("rows", 3, 0.7).alias("p")).collect()}
    assert got == {"same": [0, 1, 2], "apart": [0, 1, 3], "one": [0]}


def many_rows(n=900):
    words = [f"w{i}" for i in range(60)]
    made = []
    for i in range(n):
        topic = i % 12
        text = " ".join(words[(topic * 5 + (i * k) % 7) % 60] for k in range(1, 12)) + f" tag{i % 50}"
        made.append({**rows()[0], "doc_id": f"d{i:04d}", "text": text, "order_id": f"{i % 3:010d}", "customer_id": f"C{i % 9}"})
    return made


def test_pruned_search_loses_nothing(spark, monkeypatch):
    """Many small blocks: most are never scored, and the best rows are those of brute force."""
    from orderlens.retrieval import index as module
    from orderlens.retrieval import search

    monkeypatch.setattr(module, "BLOCK_ROWS", 8)
    made = many_rows()
    ix = build_index(corpus_of(spark, made), new_work_dir(spark, "blocks"), STOP)
    blocks = ix.bounds.select("block").distinct().count()
    assert blocks >= 100
    questions = ["w3 w4 tag7", "w10 w15 w20 w25", "tag1", "w0 w1 w2 w3 w4 w5", "w5 w6 0000000001", "w59 zzz"]
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "query_id string, query string")
    scored = []
    plain = search.block_scores
    monkeypatch.setattr(search, "block_scores", lambda blocks, *rest: scored.append(blocks) or plain(blocks, *rest))
    pool = candidates(asked, ix, STOP, 10).collect()
    assert sum(b.count() for b in scored) < 0.8 * blocks * len(questions)
    vectors, vector = model(made)
    for i, question in enumerate(questions):
        q = vector(terms(question))
        inside = [n for n, r in enumerate(made) if "0000000001" not in question or r["order_id"] == "0000000001"]
        score = {n: round(sum(w * vectors[n].get(t, 0.0) for t, w in q.items()), 9) for n in inside}
        want = sorted(inside, key=lambda n: (-score[n], made[n]["doc_id"]))[:10]
        got = sorted((r for r in pool if r["query_id"] == str(i)), key=lambda r: r["position"])
        assert [r["doc_id"] for r in got] == [made[n]["doc_id"] for n in want], question
        assert all(abs(r["score"] - score[n]) < 2e-9 for r, n in zip(got, want))


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_search_reads_few_folders_and_shuffles_no_row_pairs(spark, index):
    asked = spark.createDataFrame([("q", "credit memo")], "query_id string, query string")
    words = written(query_weights(asked, index, STOP), "asked")
    postings = in_folders(index.postings, "bucket", words, bucket_of("term"))
    reach = block_reach(words, in_folders(index.bounds, "bucket", words, bucket_of("term")))
    scores = block_scores(reach.select("query_id", "block"), words, postings)
    plan = plan_of(scores)
    assert "PartitionFilters: [bucket" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*place", plan)
    found = plan_of(candidates(asked, index, STOP, 5))
    assert "PartitionFilters: [bucket" in found
    assert "Python" not in plan_of(retrieve(asked, index, stop_words=STOP))


def test_index_is_reused_until_the_corpus_changes(spark):
    root = new_work_dir(spark, "kept")
    corpus = corpus_of(spark, rows())
    mark = corpus_fingerprint(corpus)
    assert mark == corpus_fingerprint(corpus.repartition(3)) != corpus_fingerprint(corpus.limit(5))
    reuse_or_build(corpus, root, STOP)
    assert path_exists(spark, f"{root}/index-{mark}/postings/_SUCCESS")
    assert reuse_or_build(corpus, root, STOP).docs.count() == 20


def test_summary(spark, index):
    asked = spark.createDataFrame(
        [("a", "late delivery complaint 0000000004"), ("b", "x")], "query_id string, query string"
    )
    got = {r["query_id"]: r for r in answer(asked, index, 3, stop_words=STOP).collect()}
    a = got["a"]
    assert a["summary"].startswith(
        "Retrieved 1 evidence records. Relevant orders: 0000000004. Relevant customers: C"
    )
    assert "1/1 results are email records | Key themes: 'complaint' (1×), 'late' (1×)." in a["summary"]
    assert a["summary"].endswith("(Extractive summary — based only on retrieved records.)")
    assert a["evidence"][0]["snippet"].startswith("urgent complaint about late delivery")
    assert a["meta"]["entity_counts"] == {"email": 1}
    assert a["meta"]["keyword_themes"] == {"complaint": 1, "late": 1}
    none = answer(asked, index, 3, stop_words=STOP, filters={"customer_id": "nobody"}).first()
    assert none["summary"] == NOTHING_FOUND and none["evidence"] is None


def test_default_stop_words(spark):
    assert "the" in default_stop_words()


def test_terms_are_counted_inside_their_row(spark):
    from orderlens.retrieval.index import each_term, term_counts, term_runs

    texts = ["b a b a b", "", None, "the", "x1", "été ÉTÉ the été"]
    df = spark.createDataFrame(list(enumerate(t and t.replace("a", "aa").replace("b", "bb") for t in texts)), "k long, text string")
    runs = term_runs(df, ["k"], ["the"])
    got = sorted(map(tuple, each_term(runs, ["k"]).collect()))
    assert got == sorted(map(tuple, term_counts(df, ["k"], ["the"]).collect()))
    assert ("bb", 3) in [(r[1], r[2]) for r in got] and ("été", 3) in [(r[1], r[2]) for r in got]
    plan = each_term(runs, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_what_only_the_build_reads_is_removed(spark):
    path = new_work_dir(spark, "lean")
    ix = build_index(corpus_of(spark, rows()), path, STOP)
    assert not any(path_exists(spark, f"{path}/{name}") for name in ("terms", "idfs"))
    kept = spark.read.parquet(f"{path}/vectors")
    assert "weights" not in kept.columns  # they fill most of a file, their factors little
    product = "transform(arrays_zip(tfs, idfs), x -> x.tfs * x.idfs / norm)"
    assert sorted(kept.selectExpr("place", f"{product} AS w").collect()) == sorted(
        ix.vectors.select("place", "weights").collect()
    )
    entries = {(r.place, r.term): r.weight for r in ix.postings.collect()}
    greatest = {}
    for (place, term), weight in entries.items():
        block = place // 128, term
        greatest[block] = max(weight, greatest.get(block, 0.0))
    assert {(r.block, r.term): r.bound for r in ix.bounds.collect()} == greatest
