"""Nearest vectors by learned partitions: a balanced cut of a neighbour graph, and a small
classifier that routes queries to their most probable partitions.

Fit, on a bounded sample (SAMPLE_ROWS rows and SAMPLE_BYTES bytes, the smallest hashes of the
id): every sampled vector is linked to its nearest ones by inner product, the graph is halved
again and again (a spectral order cut at its middle, then swaps that lower the cut), and a
network with one hidden layer learns, for each vector, which partitions its neighbours are in.

Index: every row goes to its most probable partition; large partitions are split into blocks.

Search: every query goes to its most probable partitions and is compared with all rows of
these, in blocks of bounded size; the best of all blocks are merged. How many partitions are
probed is measured, not set: CALIBRATION queries are compared with every row, and the fewest
partitions are taken with which these find the share `recall` of their true neighbours. Vectors
without any structure therefore probe many partitions, clustered ones few.

Defined cases:
- vectors that are null, zero, hold null or non-finite components, or have another length than
  the row of the smallest id, take no part; nor do rows without an id;
- of repeated rows and of rows that share an id, the one with the largest inner product stands
  for the id; no row with the query's own id is its neighbour;
- equal scores follow the id; equal vectors have equal scores, wherever they lie;
- a query probes further partitions until they hold more than k ids, so that it gets k rows, or
  all there are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.codes import finite, gathered
from orderlens.llm.common import prepare, written

NEAREST = 20
RECALL = 0.93
PARTITION_ROWS = 4096
MAX_PARTITIONS = 512
# Bounds of the sample that the index is fitted on.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20
SAMPLE_PER_PARTITION = 128
CALIBRATION = 256
# Rows and queries that meet in one task, and the part of them compared at once.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8_192
CHUNK = 512
LINKS = 12
HIDDEN = 128
EPOCHS, STEP, MINIBATCH = 30, 3e-3, 256
SEED = 11


# --- Fit ---------------------------------------------------------------------


def neighbour_links(vectors: np.ndarray, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the links from every vector to those of largest inner product."""
    n = len(vectors)
    links = min(links, n - 1)
    ends = np.empty((n, links), np.int64)
    for at in range(0, n, CHUNK):
        scores = vectors[at : at + CHUNK] @ vectors.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        ends[at : at + CHUNK] = np.argpartition(-scores, links - 1, axis=1)[:, :links]
    return np.repeat(np.arange(n), links), ends.ravel()


def _halves(n: int, source: np.ndarray, target: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """True for one half of the nodes of a graph; few links join the halves."""
    u, v = np.concatenate([source, target]), np.concatenate([target, source])
    degree = np.maximum(np.bincount(u, minlength=n), 1)
    order = random.normal(size=n)
    for _ in range(40):  # power iteration towards the second eigenvector of the walk
        order = (order + np.bincount(u, weights=order[v], minlength=n) / degree) / 2
        order -= (order * degree).sum() / degree.sum()
        order /= max(np.linalg.norm(order), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(order, kind="stable")[n // 2 :]] = True
    cut = np.count_nonzero(side[source] != side[target])
    for _ in range(12):  # swap nodes that have most links across, while the cut falls
        across = np.bincount(u, weights=side[u] != side[v], minlength=n)
        gain = 2 * across - np.bincount(u, minlength=n)
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        pairs = min(len(ones), len(zeros))
        worth = np.count_nonzero(gain[ones[:pairs]] + gain[zeros[:pairs]] > 0)
        swapped = max(1, worth // 4)
        trial = side.copy()
        trial[ones[:swapped]], trial[zeros[:swapped]] = False, True
        new = np.count_nonzero(trial[source] != trial[target])
        if not worth or new >= cut:
            break
        side, cut = trial, new
    return side


def balanced_partition(n: int, source: np.ndarray, target: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """The part (0 to parts - 1, a power of two) of each node; sizes differ by one at most a cut."""
    random = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    while parts > 1:
        parts //= 2
        for p in range(int(part.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[source] >= 0) & (place[target] >= 0)
            side = _halves(len(nodes), place[source[inside]], place[target[inside]], random)
            part[nodes] = 2 * p + side
    return part


@dataclass(frozen=True)
class Router:
    """A hidden layer and a softmax over partitions, on the directions of vectors."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        layer = np.maximum(unit(vectors) @ self.hidden + self.hidden_bias, 0)
        return layer @ self.out + self.out_bias


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_router(vectors: np.ndarray, wanted: np.ndarray, seed: int = SEED) -> Router:
    """wanted[row, part]: the share of the row's neighbours in the part."""
    random = np.random.default_rng(seed)
    rows, dim = vectors.shape
    parts = wanted.shape[1]
    inputs = unit(vectors)
    weights = [
        random.normal(0, (2 / dim) ** 0.5 * dim**0.5 / 2, (dim, HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(rows)
        for at in range(0, rows, MINIBATCH):
            chosen = order[at : at + MINIBATCH]
            x, y = inputs[chosen], wanted[chosen]
            before = x @ weights[0] + weights[1]
            layer = np.maximum(before, 0)
            logits = layer @ weights[2] + weights[3]
            share = np.exp(logits - logits.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            slope = (share - y) / len(x)
            back = slope @ weights[2].T * (before > 0)
            slopes = [x.T @ back, back.sum(0), layer.T @ slope, slope.sum(0)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                rate = STEP * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                weights[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    return Router(*weights)


def fit(sample: np.ndarray, parts: int) -> Router:
    source, target = neighbour_links(sample)
    part = balanced_partition(len(sample), source, target, parts)
    wanted = np.zeros((len(sample), parts))
    np.add.at(wanted, (source, part[target]), 1.0)
    wanted[np.arange(len(sample)), part] += 1
    return fit_router(sample, wanted / wanted.sum(1, keepdims=True))


# --- Tasks -------------------------------------------------------------------


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def leading(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `vectors` with the k largest inner products per query, and these.

    The products of the few leading rows are added up once more, row by row, so that equal
    vectors score alike whatever block they are compared in.
    """
    kept_rows = np.zeros((len(queries), 0), np.int64)
    kept_scores = np.zeros((len(queries), 0))
    for at in range(0, len(vectors), CHUNK * 16):
        scores = queries @ vectors[at : at + CHUNK * 16].T
        rows = np.broadcast_to(np.arange(at, at + scores.shape[1]), scores.shape)
        scores, rows = np.concatenate([kept_scores, scores], 1), np.concatenate([kept_rows, rows], 1)
        if scores.shape[1] > k:
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            scores, rows = np.take_along_axis(scores, best, 1), np.take_along_axis(rows, best, 1)
        kept_scores, kept_rows = scores, rows
    exact = np.empty_like(kept_scores)
    for i in range(len(queries)):
        exact[i] = (vectors[kept_rows[i]] * queries[i]).sum(1)
    return kept_rows, exact


def nearest_ids(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of the k best ids of each query among these rows; the
    query's own id is left out. Equal vectors are compared once."""
    whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, name = np.unique(whole, return_index=True, return_inverse=True)
    order = np.lexsort((ids, name))
    pair = np.ones(len(order), bool)  # an id repeated with the same vector counts once
    pair[1:] = (name[order][1:] != name[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[pair]
    begins = np.searchsorted(name[order], np.arange(len(first)))
    sizes = np.minimum(np.diff(np.append(begins, len(order))), k + 1)
    distinct = vectors[first]
    # Rows of one id with different vectors may crowd the list, and rounding may swap close rows.
    repeated = len(order) - len(np.unique(ids[order]))
    reach = min(len(distinct), k + 1 + min(repeated, len(distinct)) + 8)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), CHUNK):
        rows, scores = leading(queries[at : at + CHUNK], distinct, reach)
        here = np.repeat(np.arange(at, at + len(rows)), rows.shape[1])
        rows, scores = rows.ravel(), scores.ravel()
        copies = sizes[rows]
        here, scores = np.repeat(here, copies), np.repeat(scores, copies)
        inner = np.arange(len(here)) - np.repeat(np.cumsum(copies) - copies, copies)
        found = ids[order[np.repeat(begins[rows], copies) + inner]]
        other = found != query_ids[here]
        here, scores, found = here[other], scores[other], found[other]
        if repeated:  # the best row of an id stands for it
            best = np.lexsort((-scores, found, here))
            here, scores, found = here[best], scores[best], found[best]
            new = np.ones(len(here), bool)
            new[1:] = (here[1:] != here[:-1]) | (found[1:] != found[:-1])
            here, scores, found = here[new], scores[new], found[new]
        rank = np.lexsort((found, -scores, here))
        here, scores, found = here[rank], scores[rank], found[rank]
        start = np.searchsorted(here, here, side="left")
        top = np.arange(len(here)) - start < k
        out.append((here[top], found[top], scores[top]))
    if not out:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- Index and search --------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """rows: id, vector, part. probes: partitions of a query, with the recall measured at it."""

    rows: DataFrame
    router: Router | None
    sizes: list[int]
    probes: int
    recall: float


def usable_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where(
        F.col("id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0)
    )
    first = rows.agg(F.min(F.struct("id", F.size("vector").alias("n"))).alias("m"))
    return rows.where(F.size("vector") == (first.select("m.n").first()["n"] or 0))


def _sample(rows: DataFrame, count: int) -> np.ndarray:
    """The vectors of the `count` smallest hashes of the id; the same rows in every run."""
    found = rows.select("id", "vector", F.xxhash64("id").alias("h")).orderBy("h", "id", "vector").limit(count)
    return matrix(found.select("vector").toArrow().column(0))


def true_neighbours(rows: DataFrame, queries: list, vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(place of the query, part of the neighbour) over all rows, for a few queries."""
    query_ids = np.array(queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BLOCK_ROWS):
            ids, part = np.asarray(table.column("id")), np.asarray(table.column("part"))
            place, found, score = nearest_ids(query_ids, vectors, ids, matrix(table.column("vector")), k)
            of = dict(zip(ids.tolist(), part.tolist(), strict=True))
            parts = pa.array([of[i] for i in found.tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), pa.array(found), pa.array(score), parts], ["query", "id", "score", "part"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "part")
    found = rows.select("id", "vector", "part").mapInArrow(compare, f"query int, id {kind}, score double, part int")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return [(r["query"], r["part"]) for r in found.select("query", "part").collect()]


def routes(router: Router, vectors: np.ndarray) -> np.ndarray:
    """All partitions of each query, the most probable first."""
    return np.argsort(-router.scores(vectors), axis=1, kind="stable")


def probes_for(found: list[tuple[int, int]], route: np.ndarray, recall: float) -> tuple[int, float]:
    """The fewest partitions that hold the share `recall` of the neighbours found."""
    if not found:
        return 1, 1.0
    query, part = np.array(found).T
    rank = np.argsort(route, axis=1)[query, part]
    share = np.cumsum(np.bincount(rank, minlength=route.shape[1])) / len(rank)
    probes = int(np.argmax(share >= recall)) + 1
    return probes, float(share[probes - 1])


def build_index(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, recall: float = RECALL,
                partition_rows: int = PARTITION_ROWS) -> Index:
    """Fits the router on a sample, puts every row into its partition and measures the probes.

    vectors and queries: id, vector.
    """
    rows = written(vectors, "vectors")
    count = rows.count()
    parts = 1
    while parts < MAX_PARTITIONS and 2 * parts * partition_rows <= 2 * count:
        parts *= 2
    if parts == 1:
        return Index(rows.withColumn("part", F.lit(0)), None, [count], 1, 1.0)
    dim = rows.select(F.size("vector")).first()[0]
    sampled = min(SAMPLE_ROWS, parts * SAMPLE_PER_PARTITION, max(256, SAMPLE_BYTES // (8 * dim)))
    sample = _sample(rows, sampled)
    parts = min(parts, 1 << max(0, (len(sample) // 8).bit_length() - 1))
    router = fit(sample, parts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            part = pa.array(router.scores(matrix(table.column("vector"))).argmax(1), pa.int32())
            yield from table.append_column("part", part).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(rows.mapInArrow(assign, f"{kinds}, part int"), "placed")
    sizes = [0] * parts
    for row in placed.groupBy("part").agg(F.count_distinct("id").alias("n")).collect():
        sizes[row["part"]] = row["n"]
    asked = queries.select("id", "vector", F.xxhash64("id").alias("h")).orderBy("h", "id", "vector").limit(CALIBRATION)
    asked = asked.select("id", "vector").toArrow()
    if not asked.num_rows:
        return Index(placed, router, sizes, 1, 1.0)
    asked_vectors = matrix(asked.column("vector"))
    found = true_neighbours(placed, asked.column("id").to_pylist(), asked_vectors, k)
    return Index(placed, router, sizes, *probes_for(found, routes(router, asked_vectors), recall))


def routed(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """id, vector, part: each query with the partitions it probes."""
    if index.router is None:
        return queries.withColumn("part", F.lit(0))
    router, probes, sizes = index.router, index.probes, np.array(index.sizes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = routes(router, matrix(batch.column("vector")))
            held = np.cumsum(sizes[order], axis=1)
            enough = np.count_nonzero(held <= k, axis=1) + 1  # the query's own id is among them
            taken = np.arange(order.shape[1]) < np.maximum(probes, enough)[:, None]
            lists = pa.array([o[t].tolist() for o, t in zip(order, taken, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "vector", "parts"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    found = queries.mapInArrow(route, f"{kinds}, parts array<int>")
    return found.select("id", "vector", F.explode("parts").alias("part"))


def _blocks(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """part and the number of blocks of at most some block_rows rows it is split into."""
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("part", F.ceil(F.col("n") / block_rows).cast("int").alias(name))


def search(queries: DataFrame, index: Index, k: int = NEAREST,
           block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest ids of every query (id, vector)."""
    asked = written(routed(queries, index, k), "routed")
    # One row per partition, of which there are at most MAX_PARTITIONS.
    grid = _blocks(index.rows, block_rows, "row_blocks").join(_blocks(asked, block_queries, "query_blocks"), "part")
    grid = F.broadcast(grid)
    pick = lambda blocks: F.pmod(F.xxhash64("id", "vector"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = asked.join(grid, "part").select(
        "part", pick("query_blocks").alias("qb"), each("row_blocks").alias("rb"), "id", "vector")
    right = index.rows.join(grid, "part").select(
        "part", pick("row_blocks").alias("rb"), each("query_blocks").alias("qb"), "id", "vector")
    kind = queries.schema["id"].dataType.simpleString()

    def compare(some: pa.Table, rows: pa.Table) -> pa.Table:
        ids = some.column("id").combine_chunks()
        place, found, score = nearest_ids(
            np.asarray(ids), matrix(some.column("vector")), np.asarray(rows.column("id")), matrix(rows.column("vector")), k
        ) if some.num_rows and rows.num_rows else (np.zeros(0, np.int64), np.asarray(ids[:0]), np.zeros(0))
        return pa.table([ids.take(pa.array(place)), pa.array(found, ids.type), pa.array(score)], ["query_id", "vec_id", "score"])

    keys = ["part", "rb", "qb"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, f"query_id {kind}, vec_id {kind}, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = NEAREST, key: str = "vec_id",
                       vector: str = "embedding") -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`, among all other rows."""
    prepare(vectors.sparkSession)
    rows = usable_vectors(vectors, key, vector)
    asked = rows.where(F.col("id") % every == 0)
    index = build_index(rows, asked, k)
    return search(index.rows.where(F.col("id") % every == 0).select("id", "vector"), index, k)
