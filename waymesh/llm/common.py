"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import join_small, widen

__all__ = ["once", "widen"]


def once(df: DataFrame, key: str, first: str) -> DataFrame:
    """One row for each ``key``: of repeated ones the first by ``first``.

    Only the keys are shuffled to find repeated ones; the texts of documents
    that come once stay where they are.  Rows with a null key are kept.
    """
    twice = df.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).select(key)
    twice = twice.withColumn("__twice", F.lit(True))
    if not twice.head(1):
        return df
    marked = join_small(df, twice, key)
    single = marked.filter(F.col("__twice").isNull()).select(*df.columns)
    row = F.struct(*[F.col(c) for c in df.columns])
    rest = marked.filter(F.col("__twice")).groupBy(key).agg(F.min_by(row, F.struct(first, *[c for c in df.columns if c not in (key, first)])).alias("r"))
    return single.unionByName(rest.select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns]))
