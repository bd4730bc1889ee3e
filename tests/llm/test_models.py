"""Language identification, toxicity and PPM: held-out accuracy and brute force."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orderlens.llm import compress, language, toxicity
from orderlens.llm.common import table
from orderlens.llm.words import KeyTable, by_length

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_key_table():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64)
    keys = np.unique(np.append(keys, np.uint64(0)))
    own = KeyTable(keys)
    assert (own.find(keys) == np.arange(len(keys))).all()
    assert (own.find(keys + np.uint64(1 << 61)) == -1).all()


# --- language ----------------------------------------------------------------


def _ways(word, pieces):
    """All segmentations of a word, as lists of piece numbers."""
    for marks in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [0, *(i + 1 for i, m in enumerate(marks) if m), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(ends)]
        if all(p in pieces for p in parts):
            yield [pieces.index(p) for p in parts]


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ", b"ba", b"abab", b" ab", b"ababababa", b" ababababab", b"bababababab"]
    odds = np.random.default_rng(2).random((len(pieces), 2)) / len(pieces)
    full, own = np.vstack((odds, np.zeros(2))), language.Pieces(pieces)
    for word in (b"ab", b"abab", b"babab", b"abababababab", b"babababababb"):
        lattice = language.Lattice(own, np.frombuffer(b" " + word, np.uint8)[None, :])
        every = list(_ways(b" " + word, pieces))
        ways = [np.prod(odds[c], axis=0) for c in every]
        assert np.allclose(np.exp(lattice.log_odds(full))[0], np.sum(ways, axis=0))
        uses = np.zeros_like(full)
        for way, c in zip(ways, every, strict=True):
            for k in c:
                uses[k] += way / np.sum(ways, axis=0)
        assert np.allclose(lattice.expected(full, np.ones((1, 2)))[:-1], uses[:-1])


def test_words_of_any_length_are_one_sum():
    pieces = [b" ", b"a", b"b", b"c", b" a", b"ab", b"bab", b"abababababa", b"cc"]
    odds = np.random.default_rng(3).random((len(pieces), 2)) / len(pieces)
    scorer = language.Scorer(language.Model(["x", "y"], pieces, odds))
    rnd = np.random.default_rng(4)
    for size in (1, 5, 70, 200, 401):
        word = rnd.choice(np.frombuffer(b"ababababc", np.uint8), size).tobytes()
        logs = np.full((size + 2, 2), -np.inf)
        logs[0] = 0
        for j in range(1, size + 2):
            for k, p in enumerate(pieces):
                if (b" " + word)[:j].endswith(p):
                    logs[j] = np.logaddexp(logs[j], logs[j - len(p)] + np.log(odds[k]))
        want = logs[-1]
        assert np.allclose(scorer.long_word(word), want)
        assert np.allclose(scorer.stretched(b" " + word, window=13), want)
        parts = [p for some in scorer.pieces.parts(b" " + word, window=17) for p in some]
        assert b"".join(parts) == b" " + word
        assert np.allclose(sum(scorer.stretched(p) for p in parts), want)
        assert np.allclose(scorer.predict([word.decode()])[1][0], 1 / np.exp(want - want.max()).sum())


def test_all_pieces_of_the_vocabulary_are_found():
    pieces = language.vocabulary(language.vocabulary_path())
    own = language.Pieces(pieces)
    assert own.longest > language.HEAD
    for k in range(0, len(pieces), 97):
        begin, size, place = own.arcs(b"x" + pieces[k] + b"y")
        assert (1, len(pieces[k]), k) in set(zip(begin.tolist(), size.tolist(), place.tolist(), strict=True))


def test_unspaced_text_in_bounded_memory():
    import tracemalloc

    pieces = language.vocabulary(language.vocabulary_path())
    odds = np.full((len(pieces), 4), 1 / len(pieces))
    text = "".join(map(chr, np.random.default_rng(5).integers(0x4E00, 0x9FA5, 350_000)))
    scorer = language.Scorer(language.Model(list("abcd"), pieces, odds))
    toxic = toxicity.Scorer(np.zeros(toxicity.BUCKETS + 1))
    tracemalloc.start()
    names, scores = scorer.predict([text])
    assert names == ["a"] and scores[0] == pytest.approx(0.25)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.reset_peak()
    assert toxic.scores([text])[0] == pytest.approx(0.5)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_words_are_learnt_for_whole_groups_of_texts(monkeypatch):
    pieces = [bytes([b]) for b in range(1, 256)] + [b" ab", b"cd"]
    odds = np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 2).T
    model = language.Model(["x", "y"], pieces, odds)
    texts = ["ab cd", "", None, "abcd " * 9, "q" * 200 + " ab", "new words here", "12 34", "ab"]
    want = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "CACHED_WORDS", 2)
    for most in (1, 3, 8):
        monkeypatch.setattr(language, "TEXT_WORDS", most)
        scorer = language.Scorer(model)
        for _ in range(2):
            names, scores = scorer.predict(texts)
            assert names == want[0]
            assert np.allclose(scores, want[1])
    assert language.Scorer(model).predict([])[0] == []


def test_language_accuracy_on_held_out(spark):
    docs = table(spark, MIDDLE, "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_of_odd_rows(odd, nothing):
    rows = language.identify(odd).collect()
    assert len(rows) == 16
    named = defaultdict(set)
    for r in rows:
        named[r.doc_id].add(r.lang_pred)
    assert all(named[i] == {"und"} for i in (1, 2, 3, 10)) and named[7] == {"en"} and named[8] == {"en"}
    assert language.identify(nothing).collect() == []
    model = language.fit(nothing)
    assert {r.lang_pred for r in language.predict(odd, model).collect()} == {"und"}


# --- toxicity ----------------------------------------------------------------


def test_toxicity_on_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([[a > b for b in good] for a in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([s >= 0.3 for s in good]) < 0.05 < 0.6 < np.mean([s >= 0.3 for s in bad])


def test_misspelt_words_share_vectors():
    clean = [b"what a calm and sunny morning".split(), b"rain falls over the green hills".split()] * 20
    toxic = [b"you are an idiot and a clown".split(), b"such an idiotic clownish thing".split()] * 20
    model = toxicity.train(clean + toxic, np.array([0] * 40 + [1] * 40))
    scores = toxicity.Scorer(model).scores(["calm morning hills", "idiott clownn", None, ""])
    assert scores[0] < 0.3 and scores[1] > 0.7 and scores[2] == scores[3]


def test_long_texts_of_one_label_thin_that_label_alone(spark):
    held = {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(i, "calm words " * (20_000 if i < 20 else 3), 0) for i in range(600)] + [(i, "idiot clown", 1) for i in range(600, 620)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample, counts = toxicity.labelled_sample(docs, labels, most_bytes=100_000)
    assert counts == {y: sum(r[2] == y and r[0] not in held for r in rows) for y in (0, 1)}
    assert sum(y for _, y in sample) == counts[1]
    calm = sum(y == 0 and len(t) < 100 for t, y in sample)
    assert toxicity.LEAST_ROWS <= calm <= counts[0]


def test_toxicity_of_odd_rows(odd, nothing, labels):
    assert toxicity.score_documents(odd, labels).count() == 16
    assert toxicity.score_documents(nothing, labels).collect() == []
    rows = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert all(r.score == pytest.approx(0, abs=1e-6) and r.predicted == 0 for r in rows)
    kept = toxicity.without_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 16


# --- PPM -----------------------------------------------------------------------


class Plain:
    """PPM with escape C and exclusion, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.seen = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = [257] * order + list(t) + [256]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.seen[k][tuple(s[i - k : i])][s[i]] += 1

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            found = self.seen[k].get(tuple(context[len(context) - k :]), {})
            left = {s: n for s, n in found.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / total)
            out += math.log10(len(left) / total)
            excluded |= set(left)
        return out + math.log10(1 / (257 - len(excluded)))

    def score(self, text):
        s = [257] * self.order + list(text) + [256]
        return sum(self.log10(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))


def check_ppm(rows, scored, order):
    texts = [(i, (t or "").encode()) for i, t in rows]
    learnt = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    words = Counter(w for t in learnt for w in t.lower().split())
    words[None] = len(learnt)
    words += Counter()
    total, plain = sum(words.values()), Plain(learnt, order)
    want = []
    for i, t in texts:
        tokens = [*t.lower().split(), None]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in tokens)
        want.append((str(i), len(tokens), sum(words[w] > 0 for w in tokens), total, base, plain.score(t)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5, abs=1e-6)


def test_ppm_against_brute_force(spark):
    docs = table(spark, SMALL, "documents").where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_ppm(rows, compress.score_documents(docs, frequent=300).collect(), compress.ORDER)


@pytest.mark.parametrize("nodes", [0, 3000])
def test_ppm_scores_do_not_depend_on_what_tasks_hold(spark, nodes):
    docs = table(spark, SMALL, "documents").where("length(text) < 800")
    strange = [(i, f"zq\x00 {i} Ωž qqxz thé") for i in range(9000, 9020)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(strange, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_ppm(rows, compress.score_documents(docs, nodes=nodes).collect(), compress.ORDER)


def test_ppm_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_ppm(rows, compress.score_documents(odd, order=2, frequent=4).collect(), 2)
    assert compress.score_documents(nothing).collect() == []


def test_ppm_of_string_ids_and_long_words(spark):
    rows = [(f"d-{i}", "x" * 300 + f" ab {'y' * (60 + i)} ab") for i in range(12)] + [(None, "x" * 300), ("02", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = compress.score_documents(docs, order=2)
    assert found.schema["doc_id"].dataType.simpleString() == "string"
    check_ppm(rows, found.collect(), 2)


def test_least_count_that_leaves_at_most_so_many(spark):
    counts = [1] * 40 + [2] * 20 + [3] * 7 + [16_390, 20_000, 20_000, 1 << 40]
    frame = spark.createDataFrame([(n,) for n in counts], "n long")
    for most in (0, 1, 2, 3, 4, 10, 11, 30, 31, 70, 71, 100):
        want = min(n for n in [*counts, *(c + 1 for c in counts)] if sum(c >= n for c in counts) <= most)
        least = compress._least(frame, most)
        assert sum(c >= least for c in counts) == sum(c >= want for c in counts), most


def test_ppm_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = compress.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert row.score == pytest.approx(3 * math.log10(1 / 257)) and row.base_score == pytest.approx(0)


def test_ppm_stays_a_distribution_when_pruned(spark):
    docs = table(spark, SMALL, "documents").where("doc_id < 60")
    model, _ = compress.fit(docs, nodes=3000)
    assert sum(len(k) for k, _ in model.levels[1:]) <= 3000
    own = compress.Trie(model.levels)
    for context in (b"the ", b"zq\x00x", "é e".encode(), b" thx"):
        head = np.array([257] * 4 + list(context), np.int64)
        places, parts = [], []
        for symbol in range(257):
            parts.append(np.append(head, symbol))
            places.append(len(head) * (symbol + 1) + symbol)
        total = (10 ** own.log10(np.concatenate(parts), np.array(places))).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_by_length_keeps_places():
    words = [b"aa", b"b", b"cc", b"ddd"]
    assert {words[i]: bytes(m) for at, matrix in by_length(words) for i, m in zip(at, matrix, strict=True)} == {w: w for w in words}
