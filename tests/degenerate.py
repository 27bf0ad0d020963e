"""Input tables without rows, and with nulls in every column."""

import os

from tests.compare import DATA


def degenerate(spark, folder, kind):
    """All tables with the columns they have: no row at all, or one row of nulls, twice, beside the real ones."""
    for f in sorted(os.listdir(DATA)):
        t = spark.read.parquet(f"{DATA}/{f}")
        none = spark.createDataFrame([tuple(None for _ in t.columns)] * 2, t.schema)
        (t.limit(0) if kind == "empty" else t.unionByName(none)).coalesce(1).write.parquet(f"{folder}/{f}")
    return str(folder)
