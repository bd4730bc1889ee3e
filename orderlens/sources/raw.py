"""Raw tables: parquet files, relational tables behind an allow-list, fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..constants import ALLOWED_DATABASE_TABLES
from ..session import spread
from .schemas import REQUIRED

# --- Fixed values: logical name -> file below the raw folder ----------------
RAW_FILES = {
    "communications": "all_communications.parquet",
    "erp_transactions": "erp_transactions.parquet",
    "sales_documents": "sales_documents.parquet",
    "sales_items": "sales_items.parquet",
    "supporting_documents": "supporting_documents.parquet",
    "business_documents": "business_documents.parquet",
}


def raw_paths(root: str) -> dict[str, str]:
    return {name: f"{root.rstrip('/')}/{file}" for name, file in RAW_FILES.items()}


def read_raw(
    spark: SparkSession, root: str, name: str, partitions: int | None = None
) -> DataFrame:
    """One raw parquet table; of the order lines only the columns in use.

    partitions (or the session setting of the readers) deals the rows over so many tasks.
    """
    df = spark.read.parquet(raw_paths(root)[name])
    return spread(df.select(*REQUIRED[name]) if name == "erp_transactions" else df, partitions)


def read_database_table(spark: SparkSession, table: str, **options: str) -> DataFrame:
    """A table of the mail database through JDBC; only listed names are let through.

    options go to the reader: url, driver, user, and for large tables
    partitionColumn, lowerBound, upperBound and numPartitions for a parallel scan.
    """
    if table not in ALLOWED_DATABASE_TABLES:
        raise ValueError(
            f"database table {table!r} is not allowed, choose from {ALLOWED_DATABASE_TABLES}"
        )
    return spark.read.format("jdbc").options(dbtable=table, **options).load()


def read_all(
    spark: SparkSession,
    root: str,
    database: dict[str, str] | None = None,
    partitions: int | None = None,
) -> dict[str, DataFrame]:
    """Every raw table as a lazy DataFrame; database tables when options are given."""
    tables = {name: read_raw(spark, root, name, partitions) for name in RAW_FILES}
    if database:
        for table in ALLOWED_DATABASE_TABLES:
            tables[f"sqlite_{table}"] = read_database_table(spark, table, **database)
    return tables


def file_listing(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, path below the table's own folder, length and modification time of each file;
    contents stay unread."""
    listing = None
    for name, path in sorted(paths.items()):
        try:
            found = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .load(path)
                .select(
                    F.lit(name).alias("name"),
                    F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1], -1).alias("path"),
                    "length", "modificationTime",
                )
            )
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        listing = found if listing is None else listing.unionByName(found)
    if listing is None:
        raise FileNotFoundError(f"none of the raw paths exists: {sorted(paths.values())}")
    return listing


def fingerprint(listing: DataFrame) -> DataFrame:
    """One SHA-256 over all raw files: a tree of hashes with three levels.

    A file's entry is the hash of its name, place below the table, length and time. Entries are
    sorted and hashed per table and first digits of the entry, these nodes per table, and the
    tables together: a table of a million files is never listed in one place, and moving the
    folder changes nothing.
    """
    entry = F.sha2(
        F.concat_ws("|", "name", "path", "length", F.unix_micros("modificationTime").cast("string")), 256
    )
    folded = lambda column: F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256)
    nodes = (
        listing.withColumn("entry", entry)
        .groupBy("name", F.substring("entry", 1, 3).alias("node"))
        .agg(folded("entry").alias("hash"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )
    sums = [F.sum("files").alias("files"), F.sum("bytes").alias("bytes")]
    tables = nodes.groupBy("name").agg(folded(F.concat_ws(":", "node", "hash")).alias("hash"), *sums)
    return tables.agg(folded(F.concat_ws(":", "name", "hash")).alias("fingerprint"), *sums)
