from __future__ import annotations

import re
import time

import pytest
from conftest import DOMAIN

from orderlens.operators.running import ranked_in_time
from orderlens.pipeline import Pipeline
from orderlens.session import new_work_dir, shared_dir, written
from orderlens.sources import entities
from orderlens.sources.raw import RAW_FILES, file_listing, fingerprint, raw_paths, read_database_table
from orderlens.sources.store import Store


@pytest.fixture(scope="module")
def installed(spark, raw):
    root = new_work_dir(spark, "raw")
    for name, file in RAW_FILES.items():
        df = raw[name]
        if name == "erp_transactions":
            df = df.selectExpr("*", "'unused' AS OTHER")
        df.write.parquet(f"{root}/{file}")
    return Pipeline(spark, root, new_work_dir(spark, "processed"), DOMAIN)


def test_build_writes_everything_once(installed):
    assert not installed.store.ready()
    paths = installed.build()
    assert installed.store.ready() and installed.store.missing() == []
    assert installed.table("fact_event_timeline").count() == 5 + 8 + 10
    manifest = installed.asset("build_manifest")
    assert set(manifest["tables"]) == set(paths) - {"build_manifest", "data_quality_report"}
    assert len(manifest["raw_data_fingerprint"]) == 64
    report = installed.asset("data_quality_report")
    assert report["processed_counts"]["fact_order"] == 5
    before = fingerprint(file_listing(installed.spark, {"out": paths["fact_order"]})).first()
    installed.build()
    after = fingerprint(file_listing(installed.spark, {"out": paths["fact_order"]})).first()
    assert before == after


def test_scan_reads_only_the_columns_in_use(installed, spark):
    from orderlens.sources.raw import read_raw

    lines = read_raw(spark, installed.raw_root, "erp_transactions")
    assert "OTHER" not in lines.columns
    plan = lines.select("PLANT").where("PLANT = 'PL00'")._jdf.queryExecution().executedPlan()
    assert "ReadSchema: struct<PLANT:string>" in plan.toString()
    assert "EqualTo(PLANT,PL00)" in plan.toString()


def test_unknown_and_missing_names(spark):
    store = Store(spark, new_work_dir(spark, "nothing"))
    with pytest.raises(KeyError, match="Unknown table"):
        store.read("../etc/passwd")
    with pytest.raises(KeyError, match="Unknown JSON asset"):
        store.read_json("../../etc/shadow")
    with pytest.raises(FileNotFoundError, match="orderlens build"):
        store.read("fact_order")
    with pytest.raises(ValueError, match="not allowed"):
        read_database_table(spark, "users; DROP TABLE emails", url="jdbc:none")
    with pytest.raises(FileNotFoundError):
        file_listing(spark, raw_paths(new_work_dir(spark, "nowhere")))


def test_csv_export(spark, installed):
    installed.build()
    written = installed.store.export_csv(new_work_dir(spark, "csv"))
    orders = spark.read.option("header", True).csv(written["fact_order"])
    assert orders.count() == 5 and "will_be_delayed" in orders.columns


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_one_entity_reads_one_folder(spark, built, tmp_path):
    root = str(tmp_path / "entities")
    for name, key, at in entities.LAYOUT:
        entities.write(built[name], root, name, key, at)
    page = entities.read(spark, root, "fact_event_timeline", "customer_id_clean", "KA")
    want = built["fact_event_timeline"].where("customer_id_clean = 'KA'")
    assert sorted(r["event_id"] for r in page.collect()) == sorted(r["event_id"] for r in want.collect())
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(folder#\d+\), \(folder#\d+ = \d+\)\]", plan)
    assert entities.read(spark, root, "fact_document", "order_id", "nothing").isEmpty()


def test_a_hot_entity_is_spread(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "'hot' AS customer_id_clean", "timestamp_seconds(id * 86400) AS at", "id")
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # 3000 rows would meet in one task
    try:
        entities.write(rows, str(tmp_path), "t", "customer_id_clean", "at")
    finally:
        spark.conf.set(coalesced, "true")
    files = [p for p in tmp_path.rglob("*.parquet")]
    assert len(files) > 1 and len({p.parent for p in files}) == 1


def test_ranks_of_a_key_equal_a_window(spark):
    rows = spark.range(500).selectExpr(
        "IF(id % 3 = 0, 'a', concat('k', id % 5)) AS k", "concat('e', id % 40) AS e",
        "IF(id % 11 = 0, NULL, timestamp_seconds(id % 7 * 40000)) AS at")
    want = rows.selectExpr("k", "e", "at", "rank() OVER (PARTITION BY k ORDER BY at ASC NULLS LAST, e) AS n")
    got = ranked_in_time(rows, "k", "at", "e", "n").select("k", "e", "at", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_shuffle_files_go_with_their_job(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    seen = lambda: {str(b) for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        disk.getAllBlocks()) if str(b).startswith("shuffle_")}
    before = seen()
    written(spark.range(1000).repartition(4, "id"), "shuffled")
    until = time.time() + 20
    while seen() - before and time.time() < until:
        time.sleep(0.2)
    assert not seen() - before
