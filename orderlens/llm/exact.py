"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is a row of fixed-size blocks. Blocks are sorted and named with
integers (equal name, equal block); then adjacent names are paired, the pairs are
sorted and named again, until one name is left per document. At every level a name
stands for exactly one string, so (length, last name) identifies the text without
collisions; no hash takes part in the decision.

Naming starts with a short head block. A document whose (length, head) no other
document has is already identified and is not cut further; only the rest goes through
the blocks of the whole text.

Defined cases: null text counts as empty; empty texts are equal to each other; a null
doc_id is the smallest id of its group only if all ids of the group are null; rows that
repeat a doc_id and its text are members of one group and agree in every column; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import broadcast_if_small, prepare, written

SPACES = "[\\x20\\x09-\\x0D]+"
HEAD_CHARS = 48
BLOCK_CHARS = 1024


def normalised(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key rows in sorted order with an integer name each.

    Rows are sorted by a 64-bit hash of the keys and then the keys themselves: ranges are cut
    by the hash alone, so that the driver samples eight bytes a row and keys that begin alike
    are spread. The names are written down before anyone joins them, so a task that is run
    again cannot number them differently.
    """
    names = values.select(*keys).distinct().withColumn("hash", F.xxhash64(*keys))
    names = names.repartitionByRange("hash").sortWithinPartitions("hash", *keys).drop("hash")
    return names.withColumn("name", F.monotonically_increasing_id()).checkpoint()


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, head_chars: int = HEAD_CHARS) -> DataFrame:
    """(doc_id, text_sha256, length, name) per input row; texts are equal exactly where
    (length, name) is.

    Heads and whole texts are read in two passes that share no row numbers, only values, so
    an input whose rows come in another order the second time does no harm.
    """
    prepare(docs.sparkSession)
    norm = normalised("text")
    texts = docs.select(
        "doc_id", norm.alias("norm"), F.length(norm).cast("long").alias("length"),
        F.substring(norm, 1, head_chars).alias("head"), F.sha2(norm, 256).alias("text_sha256"),
    )
    heads = written(texts.drop("norm"), "heads")
    key = ["length", "head"]
    classes = written(heads.groupBy(*key).agg(F.count("*").alias("members")), "classes")
    several = (F.col("members") > 1) & (F.col("length") > head_chars)
    tied = written(classes.where(several).select(*key), "tied")
    named = heads.join(_named(classes.where(~several), key), key)
    out = named.select("doc_id", "text_sha256", "length", F.col("name") * 2 + 1)
    if tied.isEmpty():
        return out.toDF("doc_id", "text_sha256", "length", "name")

    # Whole texts of the classes that the head cannot tell apart.
    text = texts.join(broadcast_if_small(tied), key, "left_semi").drop("head")
    text = written(text.withColumn("row", F.monotonically_increasing_id()), "texts")
    last = F.floor((F.col("length") - 1) / block_chars).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(F.col("norm"), i * block_chars + 1, F.lit(block_chars)),
    )
    blocks = text.select("row", F.posexplode(cut).alias("place", "block"))
    # Blocks are whole texts, which Spark takes for as small as their file: never broadcast.
    level = blocks.join(_named(blocks, ["block"]).hint("merge"), "block").select("row", "place", "name")
    width = -(-tied.agg(F.max("length")).first()[0] // block_chars)
    while width > 1:
        half = level.select(
            "row",
            F.floor(F.col("place") / 2).alias("place"),
            F.when(F.col("place") % 2 == 0, F.col("name")).alias("left"),
            F.when(F.col("place") % 2 == 1, F.col("name")).alias("right"),
        )
        pairs = half.groupBy("row", "place").agg(
            F.max("left").alias("left"), F.coalesce(F.max("right"), F.lit(-1)).alias("right")
        )
        pairs = written(pairs, "pairs")
        names = _named(pairs, ["left", "right"])
        level = pairs.join(names, ["left", "right"]).select("row", "place", "name")
        width = -(-width // 2)
    whole = text.select("row", "doc_id", "text_sha256", "length").join(level.select("row", "name"), "row")
    # Even names are those of whole texts, odd ones those of heads.
    whole = whole.select("doc_id", "text_sha256", "length", F.col("name") * 2)
    return out.union(whole).toDF("doc_id", "text_sha256", "length", "name")


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS, head_chars: int = HEAD_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = written(identities(docs, block_chars, head_chars), "identities")
    groups = ids.groupBy("length", "name").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    # Written first, so that the join may split the rows of a hot group.
    return ids.join(written(groups, "groups"), ["length", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one per text, with all their columns."""
    decided = written(exact_duplicates(docs), "copies").select("doc_id", "kept", "text_sha256")
    return keep_rows(docs, decided, F.sha2(normalised("text"), 256))


def keep_rows(docs: DataFrame, decided: DataFrame, tag: Column) -> DataFrame:
    """Rows of `docs` whose (doc_id, tag) was kept; of rows that repeat both, one.

    `decided` has doc_id, kept and text_sha256 for every row. The dropped keys are taken
    out of the texts, which are not shuffled as long as these keys are few; rows that
    repeat are only looked for where there are any.
    """
    keys = decided.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count("*").alias("times")
    )
    odd = written(keys.where(~F.col("kept") | (F.col("times") > 1)), "dropped")
    # The caller's columns travel in one struct, whatever their names.
    tagged = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), tag.alias("tag"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tag") == F.col("text_sha256"))
    once = tagged.join(broadcast_if_small(odd), same, "left_anti")
    again = odd.where("kept")
    if again.isEmpty():
        return once.select("row.*")
    again = written(again, "repeated")
    repeated = tagged.join(broadcast_if_small(again), same, "left_semi").dropDuplicates(["id", "tag"])
    return once.unionByName(repeated).select("row.*")
