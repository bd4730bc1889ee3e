"""Batch search: every question of a DataFrame against one index."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CANDIDATES_PER_RESULT, MMR_LAMBDA, TOP_K
from ..functions.ids import order_reference_in
from ..session import broadcast_if_small, written
from .index import Index, block_of, bucket_of, default_stop_words, shard_of, term_counts

# Scores are compared at this precision, so that copies of a text tie whatever
# order their products were added in.
DIGITS = 9
# Blocks per question that are scored to find what the others must reach.
LEADING_BLOCKS = 4


def apply_filters(docs: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Equality filters, compared as text; empty values and unknown columns are ignored."""
    for name, value in (filters or {}).items():
        if value in (None, "", []) or name not in docs.columns:
            continue
        docs = docs.where(F.col(name).cast("string") == F.lit(str(value)))
    return docs


def query_weights(queries: DataFrame, index: Index, stop_words: Sequence[str]) -> DataFrame:
    """query_id, term, query_weight: the L2-normed vector of each question."""
    texts = queries.select("query_id", F.col("query").alias("text"))
    known = index.vocabulary.select("term", "idf")
    raw = term_counts(texts, ["query_id"], stop_words).join(known, "term")
    weighted = raw.select("query_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "query_id").select(
        "query_id", "term", (F.col("w") / F.col("norm")).alias("query_weight")
    )


def in_folders(table: DataFrame, column: str, keys: DataFrame, key: Column) -> DataFrame:
    """The table's folders that hold any of the keys; a filter on the folder column, whose
    values are few."""
    wanted = sorted(r[0] for r in keys.select(key).distinct().collect() if r[0] is not None)
    return table.where(F.col(column).isin(wanted))


def block_reach(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """query_id, block, reach: what no row of the block can exceed; no postings are read."""
    return (
        bounds.join(asked, "term")
        .groupBy("query_id", "block")
        .agg(F.sum(F.col("bound") * F.col("query_weight")).alias("reach"))
    )


def block_scores(blocks: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, block, place, score: cosines of the rows in the given blocks.

    Postings of other blocks go before anything is shuffled. Those left are dealt by question
    and block, where their rows are added up in place.
    """
    return (
        postings.select("term", "place", "weight", block_of("place").alias("block"))
        .join(asked, "term")
        .join(broadcast_if_small(blocks), ["query_id", "block"], "left_semi")
        .select("query_id", "block", "place", (F.col("weight") * F.col("query_weight")).alias("part"))
        .repartition("query_id", "block")
        .groupBy("query_id", "block", "place")
        .agg(F.round(F.sum("part"), DIGITS).alias("score"))
    )


def best_rows(
    asked: DataFrame,
    index: Index,
    pool: int,
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    reachable: Callable[[DataFrame], DataFrame] = lambda blocks: blocks,
) -> DataFrame:
    """query_id, row_key, place, score: the `pool` best rows per question that share a term.

    The blocks of greatest reach are scored first. Their pool-th best score is a floor that
    the others must be able to reach, ties included; blocks that cannot are never read. `kept`
    removes rows that may not be returned, `reachable` blocks without any other.
    """
    bounds = in_folders(index.bounds, "bucket", asked, bucket_of("term"))
    postings = in_folders(index.postings, "bucket", asked, bucket_of("term"))
    by_reach = Window.partitionBy("query_id").orderBy(F.desc("reach"), "block")
    reach = reachable(block_reach(asked, bounds))
    reach = written(reach.withColumn("n", F.row_number().over(by_reach)), "reach")
    leading = reach.where(F.col("n") <= LEADING_BLOCKS).select("query_id", "block")
    # Rows that tie with the last one stay until their keys are known.
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    first = kept(block_scores(leading, asked, postings)).withColumn("n", place)
    first = written(first.where(F.col("n") <= pool).drop("n"), "first")
    floor = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    # Scores are rounded, and bounds are added up in another order.
    able = F.col("reach") + F.lit(2 * 10.0**-DIGITS) >= F.col("floor")
    rest = (
        reach.where(F.col("n") > LEADING_BLOCKS).drop("n")
        .join(floor.where(F.col("n") >= pool).drop("n"), "query_id", "left")
        .where(F.coalesce(able, F.lit(True)))
        .select("query_id", "block")
    )
    more = kept(block_scores(written(rest, "rest"), asked, postings))
    found = first.unionByName(more).withColumn("n", place).where(F.col("n") <= pool).drop("n", "block")
    found = written(found, "found")
    rows = in_folders(index.vectors, "shard", found, shard_of("place")).select("place", "row_key")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_key")
    return (
        rows.join(broadcast_if_small(found), "place")
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= pool).drop("n")
    )


def candidates(
    queries: DataFrame,
    index: Index,
    stop_words: Sequence[str],
    pool: int,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The best `pool` corpus rows per question, with all corpus columns.

    A question that names an order with documents searches that order only. When
    fewer rows match, rows without a shared term fill up in row_key order.
    """
    docs = apply_filters(index.docs, filters)
    named = queries.withColumn("order_id", order_reference_in(F.col("query"))).select(
        "query_id", "order_id"
    )
    narrowed = written(
        named.where(F.col("order_id").isNotNull()).join(
            docs.select("order_id"), "order_id", "left_semi"
        ),
        "narrowed",
    )
    weights = written(query_weights(queries, index, stop_words), "questions")
    anywhere = narrowed.isEmpty()
    asked = weights if anywhere else weights.join(narrowed, "query_id", "left_anti")
    places = index.vectors.select("row_key", "place")
    allowed = places.join(docs.select("row_key"), "row_key", "left_semi")
    kept = lambda rows: rows if docs is index.docs else rows.join(allowed, "place", "left_semi")
    parts = [best_rows(broadcast_if_small(asked), index, pool, kept)]
    if not anywhere:
        parts.append(_inside_orders(weights, narrowed, docs, index, pool))
    top = written(reduce(DataFrame.unionByName, parts), "top")
    fillers = _fillers(queries, narrowed, top, docs, pool)
    if fillers is not None:
        placed = places.join(broadcast_if_small(fillers), "row_key", "right")
        top = written(top.unionByName(placed), "filled")
    by_copy = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_key", "copy")
    return (
        in_folders(docs, "bucket", top, bucket_of("row_key")).drop("bucket")
        .join(broadcast_if_small(top), "row_key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(pool)))))
        .withColumn("position", F.row_number().over(by_copy))
        .where(F.col("position") <= pool)
        .drop("copies", "copy")
    )


def _inside_orders(
    weights: DataFrame, narrowed: DataFrame, docs: DataFrame, index: Index, pool: int
) -> DataFrame:
    """The best rows of the order that each question names; only blocks with such rows are read."""
    orders = narrowed.select("order_id").distinct()
    of_orders = written(
        docs.select("row_key", "order_id").join(orders, "order_id", "left_semi")
        .join(index.vectors.select("row_key", "place"), "row_key")
        .select("order_id", "place", block_of("place").alias("block")),
        "order-rows",
    )
    blocks = of_orders.select("order_id", "block").distinct()
    own = lambda rows, keys, other: (
        rows.join(narrowed, "query_id").join(other, ["order_id", *keys], "left_semi").drop("order_id")
    )
    return best_rows(
        broadcast_if_small(weights.join(narrowed.select("query_id"), "query_id", "left_semi")),
        index,
        pool,
        lambda rows: own(rows, ["place"], of_orders.select("order_id", "place")),
        lambda found: own(found, ["block"], blocks),
    )


def _fillers(
    queries: DataFrame, narrowed: DataFrame, top: DataFrame, docs: DataFrame, pool: int
) -> DataFrame | None:
    """query_id, row_key, score 0 for questions that fewer than `pool` rows match, if any.

    The first `pool` rows of the corpus or order hold enough of them; Spark keeps only so
    many of each task before it ranks them.
    """
    found = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = queries.select("query_id").join(found.where(F.col("n") >= pool), "query_id", "left_anti")
    short = written(short, "short")
    if short.isEmpty():
        return None
    first = docs.select("row_key").orderBy("row_key").limit(pool).agg(F.collect_list("row_key")).scalar()
    open_ones = short.join(narrowed, "query_id", "left_anti").select(
        "query_id", F.explode(first).alias("row_key")
    )
    leading = Window.partitionBy("order_id").orderBy("row_key")
    wanted = narrowed.join(short, "query_id", "left_semi")
    inside = (
        docs.select("order_id", "row_key")
        .join(wanted.select("order_id").distinct(), "order_id", "left_semi")
        .withColumn("n", F.row_number().over(leading))
        .where(F.col("n") <= pool)
        .join(wanted, "order_id")
        .select("query_id", "row_key")
    )
    return (
        open_ones.unionByName(inside)
        .join(top, ["query_id", "row_key"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )


def similarities(rows: DataFrame, index: Index) -> DataFrame:
    """query_id, one, other, similarity: cosines of a question's rows (places) that share a term.

    Terms meet by their 64-bit hash, among the few candidates of one question.
    """
    vectors = in_folders(index.vectors, "shard", rows, shard_of("place")).drop("row_key", "shard")
    entries = vectors.join(broadcast_if_small(rows), "place").select(
        "query_id", "place", F.inline(
            F.zip_with("terms", "weights", lambda t, w: F.struct(F.xxhash64(t).alias("code"), w.alias("weights")))
        )
    )
    one, other = (
        entries.select("query_id", "code", F.col("place").alias(n), F.col("weights").alias(f"w_{n}"))
        for n in ("one", "other")
    )
    return (
        one.join(other.hint("shuffle_hash"), ["query_id", "code"])
        .where(F.col("one") <= F.col("other"))
        .groupBy("query_id", "one", "other")
        .agg(F.sum(F.col("w_one") * F.col("w_other")).alias("similarity"))
    )


def pick_diverse(rows: str, k: int, lam: float) -> Column:
    """Maximal marginal relevance: indexes picked one by one from an array of (score, alike),
    where alike holds the similarity to each row of the array."""
    table = F.col(rows)

    def step(state: Column, _: Column) -> Column:
        value = lambda row, i: F.when(
            ~F.array_contains(state["picked"], i),
            F.round(lam * row["score"] - (1 - lam) * F.get(state["redundancy"], i), DIGITS),
        )
        values = F.transform(table, value)
        choice = F.array(F.array_position(values, F.array_max(values)).cast("int") - 1)
        return F.transform(
            choice,
            lambda c: F.struct(
                F.concat(state["picked"], F.array(c)).alias("picked"),
                F.zip_with(
                    state["redundancy"], F.get(table, c)["alike"], lambda a, b: F.greatest(a, b)
                ).alias("redundancy"),
            ),
        )[0]

    start = F.struct(
        F.array().cast("array<int>").alias("picked"),
        F.transform(table, lambda row: F.lit(0.0)).alias("redundancy"),
    )
    steps = F.sequence(F.lit(1), F.least(F.lit(k), F.size(table)))
    return F.aggregate(steps, start, step, lambda state: state["picked"])


def diversified(ranked: DataFrame, index: Index, k: int, lam: float = MMR_LAMBDA) -> DataFrame:
    """Adds pick (1..k) to the chosen candidates; each question is one small group.

    Only positions, scores and similarities are grouped; the picks meet their rows again.
    """
    ranked = written(ranked, "ranked")
    narrow = ranked.select("query_id", "place", "position", "score")
    rows = ranked.where(F.col("place").isNotNull()).select("query_id", "place").distinct()
    alike = similarities(rows, index)
    other = narrow.select("query_id", F.col("place").alias("next"), F.col("position").alias("at"))
    both = F.col("place").isNotNull() & F.col("next").isNotNull()
    pairs = (
        narrow.join(other, "query_id")
        .withColumns(
            {
                "one": F.when(both, F.least("place", "next")),
                "other": F.when(both, F.greatest("place", "next")),
            }
        )
        .join(alike, ["query_id", "one", "other"], "left")
        .groupBy("query_id", "position", "score")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("at", F.coalesce("similarity", F.lit(0.0)).alias("s")))
            )["s"].alias("alike")
        )
    )
    listed = pairs.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "score", "alike"))).alias("rows")
    )
    picks = listed.select(
        "query_id", "rows", F.posexplode(pick_diverse("rows", k, lam)).alias("at", "chosen")
    ).select(
        "query_id", F.get("rows", F.col("chosen"))["position"].alias("position"),
        (F.col("at") + 1).alias("pick"),
    )
    return ranked.join(picks, ["query_id", "position"])


def one_per_entity(picked: DataFrame) -> DataFrame:
    """The best pick per question, entity type and order (a missing order is one)."""
    entity = Window.partitionBy("query_id", "entity_type", "order_id").orderBy(
        F.desc("score"), "pick"
    )
    return (
        picked.withColumn("_n", F.row_number().over(entity)).where(F.col("_n") == 1).drop("_n")
    )


def retrieve(
    queries: DataFrame,
    index: Index,
    top_k: int = TOP_K,
    filters: Mapping[str, Any] | None = None,
    stop_words: Sequence[str] | None = None,
    lam: float = MMR_LAMBDA,
) -> DataFrame:
    """The evidence per question: at most top_k diverse rows, ranked by score.

    queries has query_id and query. The index always covers the full corpus;
    filters only restrict what may be returned.
    """
    words = default_stop_words() if stop_words is None else list(stop_words)
    ranked = candidates(queries, index, words, top_k * CANDIDATES_PER_RESULT, filters)
    picked = one_per_entity(diversified(ranked, index, top_k, lam))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pick")
    return (
        picked.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .drop("row_key", "position", "pick", "place")
    )


def retrieve_one(query: str, index: Index, **options: Any) -> DataFrame:
    spark = index.docs.sparkSession
    asked = spark.createDataFrame([("1", query)], "query_id string, query string")
    return retrieve(asked, index, **options).drop("query_id").orderBy("rank")
