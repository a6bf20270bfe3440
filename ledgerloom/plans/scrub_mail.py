"""Scrub a folder of .eml files into fixtures by merchant.

    python -m ledgerloom.plans.scrub_mail --in mails --out fixtures [--blocklist list.json] [--dry-run]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub
from ..sources.maildir import read_eml_folder
from ..sources.scenarios import load_blocklist
from ..sources.sinks import unique_names, write_fixtures
from ..workspace import ship_package


def scrubbed(files: DataFrame, block: scrub.Blocklist = scrub.Blocklist()) -> DataFrame:
    """(path, merchant, unique_base, content); an unknown merchant or a finding of the audit is an error."""
    merchant = scrub.merchant_of(F.col("raw"))
    rows = files.select("path", F.coalesce(merchant, F.raise_error(F.concat(F.lit("unknown merchant in "), "path")).cast("string")).alias("merchant"), scrub.slug(F.col("path")).alias("base"), scrub.export(F.col("raw"), block).alias("content"))
    return unique_names(rows)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Scrub messages into fixtures.")
    parser.add_argument("--in", dest="source", required=True)
    parser.add_argument("--out", default="")
    parser.add_argument("--blocklist", default="")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    rows = scrubbed(read_eml_folder(spark, args.source), load_blocklist(args.blocklist))
    if args.dry_run:
        rows.select("merchant", "unique_base").show(1000, truncate=False)
        n = rows.count()
    else:
        n = write_fixtures(rows, args.out)
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
