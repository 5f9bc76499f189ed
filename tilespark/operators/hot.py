"""Joins in which a few keys hold much of one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
MOST = 100_000


def deal_hot(many: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str], most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt`` to join on too, so that no key of one salt has much more than ``most`` rows of ``many``.

    Rows of ``many`` are counted per key, combined before the shuffle. Only keys above ``most``, at most one in ``most`` rows, get more
    than one salt: there ``many`` is dealt by a hash of ``spread`` and the rows of ``few`` are repeated; all others stay as they are.
    Both sides have the columns ``on``.
    """
    on = list(on)
    hot = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(
        *[F.col(k).alias(f"_hot_{k}") for k in on], F.ceil(F.col("_n") / most).cast("int").alias("_salts"))

    def met(df: DataFrame) -> DataFrame:
        match = F.lit(True)
        for k in on:
            match = match & (F.col(k) == F.col(f"_hot_{k}"))
        return df.join(hot, match, "left").drop(*[f"_hot_{k}" for k in on])

    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))
    dealt = met(many).withColumn(SALT, salt).drop("_salts")
    repeated = met(few).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt, repeated
