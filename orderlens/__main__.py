"""Command line: build the processed tables, train the risk models, export CSV.

    spark-submit --py-files orderlens.zip run.py build --raw DIR --out DIR --domain NAME
    python -m orderlens build|train|export ...
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .pipeline import Pipeline
from .risk.train import RiskModels


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="orderlens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "train", "export"):
        command = commands.add_parser(name)
        command.add_argument("--raw", required=True, help="folder of the raw tables")
        command.add_argument("--out", required=True, help="folder of the processed tables")
        command.add_argument("--domain", required=True, help="domain of internal mail addresses")
        command.add_argument("--jdbc-url", help="mail database, as a JDBC URL")
        command.add_argument("--force", action="store_true", help="redo existing outputs")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("orderlens").getOrCreate()
    database = {"url": args.jdbc_url} if args.jdbc_url else None
    pipeline = Pipeline(spark, args.raw, args.out, args.domain, database)
    if args.command == "export":
        written = pipeline.store.export_csv(f"{args.out.rstrip('/')}/csv")
    else:
        written = pipeline.build(force=args.force and args.command == "build")
    for name, path in written.items():
        print(f"  {name}: {path}")
    if args.command == "train":
        models = RiskModels(spark, f"{args.out.rstrip('/')}/models")
        record = models.train(lambda: pipeline.table("fact_order_risk_features"), args.force)
        print(json.dumps(record, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
