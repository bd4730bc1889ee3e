"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one per bit position that is set in over half of the hashes of a
text's word shingles. Two fingerprints link at two or fewer differing bits. Cut in two
halves, one half then differs by one bit at most, so both fingerprints share a variant of
that half in which this one bit is a wildcard. Every distinct fingerprint is indexed under
its 64 one-wildcard variants, variants meet in an equality join, and pairs are verified.
Each link is taken at one canonical variant only.

Equal fingerprints are one class before anything is paired. A variant shared by more than
BUCKET classes is cut once more: the other half, which may differ by two bits, has two
quarters of which one differs by one bit at most, so the same rule narrows the bucket. Links
become groups by alternating star contraction over written edge lists.

Defined cases: null counts as empty; a text without words has fingerprint zero; fewer
words than a shingle are one shingle; the smallest doc_id ignores null ids unless a group
has no other; rows that repeat a doc_id count one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm import exact
from orderlens.llm.common import prepare, raw_bytes, written

SHINGLE = 3
SEED = 42
DISTANCE = 2
BUCKET = 512
# Each class gives 64 variants; the classes are dealt over tasks of at most so many.
CLASSES_PER_TASK = 8_192
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        end = min(count, at + _CHUNK)
        hashes = [xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(at, end)]
        octets = np.array(hashes, "<u8").view(np.uint8)
        ones += np.unpackbits(octets, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    octets = np.packbits(ones * 2 > count, bitorder="little")
    return int(octets.view("<u8")[0])


def fingerprints(docs: DataFrame, *extra: Column, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, the extra columns and fp, the fingerprint as a signed long."""
    frame = docs.select("doc_id", *extra, raw_bytes("text").alias("_text"))
    kept = frame.drop("_text").schema
    names = kept.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle, seed) for t in batch.column("_text").to_pylist()]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            arrays = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*arrays, fp], [*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return frame.mapInArrow(run, f"{schema}, fp long")


def _canonical(x: str, bits: int) -> str:
    """SQL of the number of the one variant at which a pair counts.

    `x` is the difference over two parts of `bits` bits; variants are numbered part by part.
    """
    low = f"({x} & {(1 << bits) - 1}L)"
    return (
        f"CASE bit_count({low}) WHEN 0 THEN 0"
        f" WHEN 1 THEN bit_count({low} - 1) ELSE {bits} END"
    )


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in one or two bits."""
    variant = (
        "CAST(shiftleft(CAST(v AS BIGINT), 32) AS BIGINT)"
        " | ((shiftright(fp, CAST(v DIV 32 AS INT) * 32) & 4294967295L) & ~shiftleft(1L, CAST(v % 32 AS INT)))"
    )
    # Dealt first: a file of fingerprints is small, the variants made of it are not.
    tasks = max(1, -(-prints.count() // CLASSES_PER_TASK))
    variants = prints.repartition(tasks, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    variants = variants.selectExpr("fp", f"{variant} AS key")
    sizes = variants.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # Spark takes exploded rows to be as small as those before, and would broadcast all variants:
    # the joins of variants are named.
    shared = written(variants.join(sizes.hint("merge"), "key"), "variants")
    apart = "a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= 2"
    at_key = f"CAST(shiftright(a.key, 32) AS INT) = {_canonical('(a.fp ^ b.fp)', 32)}"
    small = shared.where(F.col("size") <= bucket)
    near = small.alias("a").join(small.alias("b").hint("merge"), F.expr(f"a.key = b.key AND {apart} AND {at_key}"))
    near = near.selectExpr("a.fp AS a", "b.fp AS b")
    large = shared.where(F.col("size") > bucket)
    if large.isEmpty():
        return near
    # The half that the key does not speak of, by its quarters.
    other = "(shiftright(fp, CAST(1 - shiftright(key, 37) AS INT) * 32) & 4294967295L)"
    sub = (
        "CAST(shiftleft(CAST(w AS BIGINT), 16) AS BIGINT)"
        f" | ((shiftright({other}, CAST(w DIV 16 AS INT) * 16) & 65535L) & ~shiftleft(1L, CAST(w % 16 AS INT)))"
    )
    finer = large.select("fp", "key", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("w"))
    finer = finer.selectExpr("fp", "key", f"{sub} AS sub")
    rest = "(shiftright(a.fp ^ b.fp, CAST(1 - shiftright(a.key, 37) AS INT) * 32) & 4294967295L)"
    at_sub = f"CAST(shiftright(a.sub, 16) AS INT) = {_canonical(rest, 16)}"
    both = F.expr(f"a.key = b.key AND a.sub = b.sub AND {apart} AND {at_key} AND {at_sub}")
    dense = finer.alias("a").join(finer.alias("b").hint("merge"), both).selectExpr("a.fp AS a", "b.fp AS b")
    return near.unionByName(dense)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node.

    Large-star and small-star steps take turns until the edges stand still; then every
    edge points at its root. Each step keeps at most one edge per node and neighbour.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        least = least.select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").unionByName(
            least.select("a", F.col("least").alias("b"))
        )
        edges = written(small.distinct(), "small-star")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, *extra: Column, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, the extra columns, fp, component_id."""
    prepare(docs.sparkSession)
    prints = written(fingerprints(docs, *extra, shingle=shingle, seed=seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = written(classes, "classes")
    roots = written(components(links(classes.select("fp"))), "roots")
    # Every fingerprint that has a link is a node or a root.
    rooted = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = classes.join(rooted, classes.fp == rooted.node)
    groups = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(groups, "root").select("fp", "component")
    whole = classes.join(labels, "fp", "left")
    whole = whole.select("fp", F.coalesce("component", "least").alias("component_id"))
    # Written first, so that the join may split the rows of a hot fingerprint.
    return prints.join(written(whole, "components"), "fp")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    hexa = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexa.alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each group, with all their columns."""
    tag = F.sha2(exact.normalised("text"), 256)
    found = near_duplicates(docs, tag.alias("text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    decided = written(found.select("doc_id", kept.alias("kept"), "text_sha256"), "near-copies")
    return exact.keep_rows(docs, decided, tag)
