"""Reports, tables and scrubbed messages written out."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_json(path: str, value: dict) -> None:
    """Pretty JSON; parent folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def unique_names(rows: DataFrame, folder: str = "merchant", base: str = "base", order: str = "path") -> DataFrame:
    """``unique_base``: the base name, with -n from the second use in a folder on."""
    n = F.row_number().over(Window.partitionBy(folder, base).orderBy(order))
    return rows.withColumn("unique_base", F.when(n > 1, F.concat(F.col(base), F.lit("-"), n)).otherwise(F.col(base)))


def write_fixtures(rows: DataFrame, dest: str) -> int:
    """Write (merchant, unique_base, content) to dest/merchant/base.eml from the executors; how many."""

    def put(part):
        for r in part:
            folder = os.path.join(dest, r["merchant"])
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, r["unique_base"] + ".eml"), "w", encoding="utf-8", newline="") as f:
                f.write(r["content"])

    rows = rows.select("merchant", "unique_base", "content").persist()
    try:
        rows.foreachPartition(put)
        return rows.count()
    finally:
        rows.unpersist()


def show_table(df: DataFrame, n: int = 100) -> None:
    df.show(n, truncate=False)
