"""Folds by id and bounded samples, the same at every run and for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def bounded(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` at most (all where there are fewer), chosen by a hash of ``key``.

    The sizes come from one aggregation of all rows, so the expected sample is
    the same at every input size; nothing is sorted or gathered.
    """
    shares = {x[by]: most / x["n"] for x in rows.groupBy(by).agg(F.count("*").alias("n")).collect() if x["n"] > most}
    share = F.lit(1.0)
    for value, part in shares.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(part)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
