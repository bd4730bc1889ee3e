"""The stages against brute force on whole small tables, and with odd rows."""

from __future__ import annotations

import re

import corpus_pipeline
from orderlens.llm import packing, toxicity
from orderlens.llm.common import table

from .test_decontaminate import brute as hits
from .test_packing import check
from .test_simhash import groups, plain_print

SMALL = "/root/testdata/sf0.001"


def after(docs, spark, folder, until):
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name == until:
            return docs
    raise KeyError(until)


def test_stages_one_by_one(spark):
    docs, benchmark = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    labels = table(spark, SMALL, "labels")
    rows = {r.doc_id: r for r in docs.collect()}

    out = [list(rows)]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SMALL).cache()
        assert frame.columns == docs.columns
        kept = frame.collect()
        assert all(tuple(r) == tuple(rows[r.doc_id]) for r in kept)
        out.append(sorted(r.doc_id for r in kept))
    toxic = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    assert out[1] == sorted(set(rows) - toxic)
    first = {}
    for i in out[1]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    assert out[2] == sorted(first.values())
    component = groups([(i, plain_print(rows[i].text)) for i in out[2]])
    assert out[3] == [i for i, c in zip(out[2], component, strict=True) if i == c]
    dirty = {r[0] for r in hits([(i, rows[i].text) for i in out[3]], [tuple(r) for r in benchmark.collect()]) if r[-1]}
    assert out[4] == [i for i in out[3] if i not in dirty]
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).collect()
    check(packed, [(i, rows[i].text) for i in out[4]])


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    docs = after(table(spark, SMALL, "documents"), spark, SMALL, "decontamination")
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    assert got.columns == [*[f.split()[0] for f in packing.PIECES.split(", ")], "sequence_id", "offset"]


def test_odd_rows_and_empty_table(spark, odd, nothing):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    left = after(odd, spark, SMALL, "decontamination")
    assert left.columns == odd.columns
    assert after(nothing, spark, SMALL, "packing").collect() == []
