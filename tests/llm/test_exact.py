from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from orderlens.llm import exact

from .conftest import ODD


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        least = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, least, len(groups[t]), i == least, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block, head", [(1024, 48), (7, 3), (1, 1)])
def test_odd_rows(odd, block, head):
    if block == 1:
        odd = odd.where("length(text) < 100 OR text IS NULL")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(exact.exact_duplicates(odd, block, head)) == brute(rows)


def test_texts_that_differ_in_one_block(spark):
    base = "abcdefgh" * 40
    texts = [base, base[:160] + "X" + base[161:], base, base + "a", base[:-1], base[8:] + base[:8], "X" + base[1:]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact.exact_duplicates(df, 16, 4)) == brute(rows)


def test_blocks_are_never_broadcast(spark):
    df = spark.createDataFrame([(i, "abcdefgh" * 40 + "xy"[i % 2]) for i in range(4)], "doc_id long, text string")
    plan = exact.identities(df, 512, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_empty_table(nothing):
    assert exact.exact_duplicates(nothing).collect() == []
    assert exact.without_copies(nothing).collect() == []


def test_rows_that_stay(odd):
    kept = exact.without_copies(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = {re.sub(r"[\x20\x09-\x0D]+", " ", t or ""): None for _, t in ODD}
    assert len(got) == len(want)  # one row of every text, also of a row that is repeated
    assert (-3, "One two three") in got and (1, None) in got and (9, ODD[9][1]) in got


def test_columns_of_the_caller_stay(odd):
    names = ["_id", "_tag", "_own", "_kept", "id", "tag", "row", "kept", "text_sha256", "hash", "times", "size.of"]
    wide = odd.selectExpr("*", *(f"kind || '{n}' AS `{n}`" for n in names))
    kept = exact.without_copies(wide)
    assert kept.columns == wide.columns
    rows = kept.collect()
    assert len(rows) == exact.without_copies(odd).count()
    assert all(r[n] == "kind" + n for r in rows for n in names)


def test_plan_is_native(odd):
    plan = exact.exact_duplicates(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
