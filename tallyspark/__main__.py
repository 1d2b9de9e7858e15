"""Command line: ``python -m tallyspark COMMAND``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from tallyspark.functions import catalog
from tallyspark.plans import etl_queries, panel_queries, store_queries, text_queries
from tallyspark.sources import files, sinks


def registered() -> dict[str, Callable]:
    return panel_queries.queries() | text_queries.queries() | etl_queries.queries() | store_queries.queries()


def schema(spark: SparkSession, a: argparse.Namespace) -> None:
    """Print the CREATE TABLE texts of the wide tables, or apply them."""
    for table in a.tables or catalog.TABLES:
        text = catalog.ddl(table)
        print(text)
        if a.apply:
            spark.sql(text)


def companies(spark: SparkSession, a: argparse.Namespace) -> None:
    """Load companies from a CSV into a Parquet folder, by code."""
    sinks.upsert(files.company_registry(spark, a.csv), a.out, ["stock_code"])
    print(spark.read.parquet(a.out).count())


def listed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Print the names of the registered queries."""
    print("\n".join(sorted(registered())))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run a registered query over a folder of tables and show its rows, or write them."""
    df = registered()[a.query](spark, a.tables)
    if a.out:
        sinks.file_report(df, a.out, df.columns, a.kind)
    else:
        df.show(a.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(action: Callable, name: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=action.__doc__)
        p.set_defaults(action=action)
        return p

    p = command(schema, "schema")
    p.add_argument("tables", nargs="*", choices=[*catalog.TABLES, []])
    p.add_argument("--apply", action="store_true")
    p = command(companies, "companies")
    p.add_argument("csv")
    p.add_argument("out")
    command(listed, "queries")
    p = command(run, "run")
    p.add_argument("query", choices=sorted(registered()), metavar="QUERY")
    p.add_argument("tables")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--out")
    p.add_argument("--kind", choices=("csv", "json", "markdown", "text"), default="csv")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.action(spark or SparkSession.builder.appName("tallyspark").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
