"""TF-IDF index as tables: documents, vocabulary, vectors and postings.

Word and two-word terms, smoothed idf, L2-normed vectors. Identical corpus rows
are kept once with their number of copies, so a heavily copied document costs one
row while every count and rank still sees all copies.

Rows are numbered in the order of their heaviest term and cut into blocks of BLOCK_ROWS
numbers. A bound is the greatest weight of a term inside a block, the most it can add to any
row there: a search reads the bounds first and the postings of few blocks afterwards.
Documents lie in folders by the hash of their key, bounds and postings by the hash of their
term, and vectors by the task that numbered them, so that a search opens only the folders it
needs. Vectors are kept as the factors of their weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import COLUMNS
from ..sources.store import path_exists, remove_path

TOKEN = r"([\p{L}\p{N}_]{2,})"
BLOCK_ROWS = 128
BUCKETS = 32
# Files a folder of documents is spread over.
FILES = 2
# A row number holds the task that gave it above these bits.
SHARD_BITS = 33
# A place in a row and a document frequency share a long; the frequency has these bits.
FREQUENCY_BITS = 36


@dataclass(frozen=True)
class Index:
    """row_key identifies a distinct corpus row and sorts like its doc_id."""

    docs: DataFrame  # row_key, copies, the corpus columns; folders by bucket of row_key
    vocabulary: DataFrame  # term, total, document_frequency, idf
    vectors: DataFrame  # row_key, place, terms, weights; folders by shard of place
    bounds: DataFrame  # term, block, bound; folders by bucket of term
    postings: DataFrame  # term, place, weight; folders by bucket of term


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def shard_of(place: str) -> Column:
    return F.shiftright(F.col(place), SHARD_BITS).cast("int")


def block_of(place: str) -> Column:
    return F.floor(F.col(place) / F.lit(BLOCK_ROWS))


def default_stop_words() -> list[str]:
    """Spark's English list; pass another one to change it."""
    return StopWordsRemover.loadDefaultStopWords("english")


def terms_of(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-cased tokens without stop words, then their neighbouring pairs."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)
    if stop_words:
        tokens = F.filter(tokens, lambda token: ~token.isin(list(stop_words)))
    return tokens


def with_pairs(tokens: Column) -> Column:
    follower = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.zip_with(tokens, follower, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.filter(pairs, lambda pair: pair.isNotNull()))


def term_runs(df: DataFrame, keep: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """keep, terms, tfs: the distinct terms of each row's text in order, and their counts.

    Terms are sorted and counted inside their row, so nothing is shuffled: a run of equal
    terms lasts from its start to the start of the next one.
    """
    sorted_terms = F.sort_array(with_pairs(F.col("_tokens")))
    is_start = lambda term, i: (i == 0) | (term != F.get(F.col("_sorted"), i - 1))
    starts = F.filter(
        F.transform("_sorted", lambda term, i: F.when(is_start(term, i), i)), F.isnotnull
    )
    ends = F.concat(
        F.filter("_starts", lambda start: start > 0), F.array(F.size("_sorted"))
    )
    return (
        df.select(*keep, terms_of(F.col("text"), stop_words).alias("_tokens"))
        .select(*keep, sorted_terms.alias("_sorted"))
        .where(F.size("_sorted") > 0)
        .select(*keep, "_sorted", starts.alias("_starts"))
        .select(
            *keep,
            F.transform("_starts", lambda start: F.get(F.col("_sorted"), start)).alias("terms"),
            F.zip_with(
                "_starts", ends, lambda start, end: (end - start).cast("long")
            ).alias("tfs"),
        )
    )


def each_term(runs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, term, tf: one row per distinct term of each row of term_runs."""
    pairs = runs.select(*keep, F.inline(F.arrays_zip("terms", "tfs")))
    return pairs.withColumnsRenamed({"terms": "term", "tfs": "tf"})


def term_counts(df: DataFrame, keep: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """keep, term, tf: one row per distinct term of the texts that share keep.

    Terms are counted where their text is; only the counts are shuffled.
    """
    return (
        df.select(*keep, terms_of(F.col("text"), stop_words).alias("_tokens"))
        .select(*keep, F.explode(with_pairs(F.col("_tokens"))).alias("term"))
        .groupBy(*keep, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def distinct_rows(corpus: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("\x00")) for c in COLUMNS]
    return (
        corpus.groupBy(*COLUMNS)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn(
            "row_key",
            F.concat(
                F.coalesce("doc_id", F.lit("")), F.lit("#"), F.md5(F.concat_ws("\x01", *parts))
            ),
        )
    )


def size_of(docs: DataFrame) -> Column:
    """The number of corpus rows, copies included."""
    return docs.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()


def vocabulary_of(docs: DataFrame, counts: DataFrame, size: int | None = None) -> DataFrame:
    """The terms with their idf; with size the most frequent ones, equal totals in term
    order. counts has copies, term and tf, one row per document and term."""
    totals = counts.groupBy("term").agg(
        F.sum(F.col("tf") * F.col("copies")).alias("total"),
        F.sum("copies").alias("document_frequency"),
    )
    n_docs = size_of(docs)
    if size is not None:
        totals = totals.orderBy(F.desc("total"), "term").limit(size)
    return totals.withColumn("idf", idf_of(F.col("document_frequency"), n_docs))


def idf_of(frequency: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (frequency + 1)) + 1


def idfs_of(runs: DataFrame, vocabulary: DataFrame, n_docs: Column) -> DataFrame:
    """number, idfs: the weights of a row's terms, in the order of the row, null for terms outside
    the vocabulary.

    Every term is shuffled with the number of its row and its place there; what comes back is
    the place and the document frequency in one long, so that no term is shuffled a second time.
    """
    entries = runs.select("number", F.posexplode("terms").alias("at", "term"))
    known = F.shiftleft(F.col("at").cast("long"), FREQUENCY_BITS) + F.coalesce("document_frequency", F.lit(0))
    frequency = lambda entry: entry.bitwiseAND(F.lit((1 << FREQUENCY_BITS) - 1))
    idf = lambda n: F.when(n > 0, idf_of(n, n_docs))
    return (
        entries.join(vocabulary.select("term", "document_frequency"), "term", "left")
        .groupBy("number")
        .agg(F.sort_array(F.collect_list(known)).alias("known"))
        .select("number", F.transform("known", lambda entry: idf(frequency(entry))).alias("idfs"))
    )


def vectors_of(runs: DataFrame, idfs: DataFrame) -> DataFrame:
    """row_key, terms, tfs, idfs, norm: the weights of a row are tfs * idfs / norm.

    The factors repeat and pack well, the weights do not: they are multiplied when they are read.
    """
    known = F.filter(
        F.arrays_zip("terms", "tfs", "idfs"), lambda entry: entry["idfs"].isNotNull()
    )
    square = F.transform("known", lambda entry: F.pow(entry["tfs"] * entry["idfs"], F.lit(2.0)))
    return (
        _unpacked(_packed(runs.select("number", "row_key", "terms", "tfs")).join(idfs, "number"))
        .select("row_key", known.alias("known"))
        .where(F.size("known") > 0)
        .select(
            "row_key", F.col("known.terms").alias("terms"), F.col("known.tfs").alias("tfs"),
            F.col("known.idfs").alias("idfs"),
            F.sqrt(F.aggregate(square, F.lit(0.0), lambda total, x: total + x)).alias("norm"),
        )
    )


def weighted(factors: DataFrame) -> DataFrame:
    """The vectors as a search reads them, with weights."""
    weights = F.zip_with("tfs", "idfs", lambda tf, idf: tf * idf / F.col("norm"))
    return factors.select("row_key", "place", "terms", weights.alias("weights"), "shard")


def _packed(vectors: DataFrame) -> DataFrame:
    """The terms as one text, in which they take half the room on their way through a shuffle; no
    term holds a line end."""
    return vectors.withColumn("terms", F.array_join("terms", "\n"))


def _unpacked(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("terms", F.split("terms", "\n"))


def numbered(vectors: DataFrame) -> DataFrame:
    """Adds place and shard: the rows in the order of their heaviest term.

    The ranges are drawn once, so a retried task numbers the same rows alike.
    """
    products = F.zip_with("tfs", "idfs", lambda tf, idf: tf * idf)
    heaviest = F.transform(
        F.array(products), lambda weights: F.array_position(weights, F.array_max(weights)).cast("int")
    )[0]
    dealt = (
        _packed(vectors.withColumn("_lead", F.element_at("terms", heaviest)))
        .repartitionByRange("_lead", "row_key")
        .sortWithinPartitions("_lead", "row_key")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("shard", shard_of("place"))
        .drop("_lead")
    )
    return _unpacked(dealt)


def entries_of(factors: DataFrame, *keep: str) -> DataFrame:
    """keep, term, weight: one row per term and row."""
    each = factors.select(*keep, "norm", F.inline(F.arrays_zip("terms", "tfs", "idfs")))
    weight = F.col("tfs") * F.col("idfs") / F.col("norm")
    return each.select(*keep, F.col("terms").alias("term"), weight.alias("weight"))


def postings_of(factors: DataFrame) -> DataFrame:
    """One row per term and row, sorted where its factors were read: nothing is shuffled, and a
    term of many rows is spread over the files of many tasks."""
    entries = entries_of(factors, "place").select("term", "place", "weight", bucket_of("term").alias("bucket"))
    return entries.sortWithinPartitions("bucket", "term", "place")


def bounds_of(factors: DataFrame) -> DataFrame:
    """The rows are dealt by block before they are weighted, which is far less than their
    entries; a term's entries of one block then lie in one task."""
    dealt = factors.select(block_of("place").alias("block"), "terms", "tfs", "idfs", "norm")
    entries = entries_of(_unpacked(_packed(dealt).repartition("block")), "block")
    found = entries.groupBy("block", "term").agg(F.max("weight").alias("bound"))
    return found.select("term", "block", "bound", bucket_of("term").alias("bucket"))


def build_index(
    corpus: DataFrame,
    path: str,
    stop_words: Sequence[str] | None = None,
    size: int | None = None,
) -> Index:
    """Write the tables below path and return them as read back.

    Texts are split into terms once; the vocabulary, the vectors and, from them, the
    postings derive from these counts. The numbers of the rows are kept with them, so that a
    retried task finds the same ones. Each step is written before the next one shuffles, and
    what only the build reads is removed as soon as it was read.
    """
    words = default_stop_words() if stop_words is None else list(stop_words)
    spark = corpus.sparkSession

    def table(name: str, df: DataFrame, folders: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(folders) if folders else writer).parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    file = F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(FILES))
    rows = distinct_rows(corpus).withColumn("bucket", bucket_of("row_key"))
    docs = table("docs", rows.repartition("bucket", file), "bucket")
    found = term_runs(docs, ["row_key", "copies"], words)
    runs = table("terms", found.withColumn("number", F.monotonically_increasing_id()))
    vocabulary = table("vocabulary", vocabulary_of(docs, each_term(runs, ["copies"]), size))
    idfs = table("idfs", idfs_of(runs, vocabulary, F.lit(spark.range(1).select(size_of(docs)).first()[0])))
    factors = table("vectors", numbered(vectors_of(runs, idfs)), "shard")
    for name in ("terms", "idfs"):
        remove_path(spark, f"{path}/{name}")
    postings = table("postings", postings_of(factors), "bucket")
    bounds = table("bounds", bounds_of(factors), "bucket")
    return Index(docs, vocabulary, weighted(factors), bounds, postings)


def open_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    docs, vocabulary, vectors, bounds, postings = map(
        read, ["docs", "vocabulary", "vectors", "bounds", "postings"]
    )
    return Index(docs, vocabulary, weighted(vectors), bounds, postings)


def corpus_fingerprint(corpus: DataFrame) -> str:
    """Digest of all citations and texts, whatever their order."""
    row = F.xxhash64("citation", "text").cast("decimal(38,0)")
    digest = corpus.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s"))
    return digest.select(F.md5(F.concat_ws("|", "n", "s")).alias("f")).first()["f"]


def reuse_or_build(
    corpus: DataFrame,
    root: str,
    stop_words: Sequence[str] | None = None,
    size: int | None = None,
) -> Index:
    """The index kept for this corpus, built when the corpus has changed."""
    spark = corpus.sparkSession
    path = f"{root.rstrip('/')}/index-{corpus_fingerprint(corpus)}"
    if path_exists(spark, f"{path}/bounds/_SUCCESS"):
        return open_index(spark, path)
    return build_index(corpus, path, stop_words, size)
