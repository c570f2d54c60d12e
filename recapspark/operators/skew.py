"""Joining per-key facts onto rows when a few keys own a large share of the rows."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapspark.config import HOT_KEY_SALTS, HOT_KEYS, HOT_MIN_ROWS

#: Columns that tell the captures of one frequent fish or river apart.
CAPTURE_SPREAD = ("date", "FishNum", "tblSL_SL_ID")


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    weight: str,
    spread: Sequence[str],
    keep: Column | None = None,
    hot_keys: int = HOT_KEYS,
    min_rows: int = HOT_MIN_ROWS,
    salts: int = HOT_KEY_SALTS,
) -> DataFrame:
    """Left join ``facts`` (one row per key, NULL keys match) onto ``rows``.

    ``weight`` is the number of ``rows`` per key. The ``hot_keys`` heaviest keys with at
    least ``min_rows`` rows are broadcast; any other key has fewer than ``min_rows`` rows
    or less than ``1/hot_keys`` of all, so the shuffle join that serves those is
    balanced. Rows already served by the broadcast
    need no partner there: their second join key is made of the ``spread`` columns and
    negative, so they scatter over many reducers and meet nothing.
    ``keep`` is a predicate over the payload; it runs right after the broadcast, so
    rejected rows of heavy keys are never shuffled.

    That key is a function of stored columns: a recomputed task sends every row to the
    same reducer as before.
    """
    aliases = [f"_k{i}" for i in range(len(keys))]
    facts = facts.select(
        *[F.col(k).alias(a) for k, a in zip(keys, aliases)],
        F.struct(*payload, F.col(weight).alias("_weight")).alias("_fact"),
    )
    hot = (
        facts.filter(F.col("_fact._weight") >= min_rows)
        .orderBy(F.desc("_fact._weight"), *aliases)
        .limit(hot_keys)
        .select(*aliases, F.col("_fact").alias("_hot"))
    )

    def bucket(columns):
        return F.pmod(F.xxhash64(*columns), F.lit(salts))

    cold = facts.select(
        *aliases, F.col("_fact").alias("_cold"), bucket(aliases).alias("_cold_bucket")
    )
    columns = [c for c in rows.columns if c not in payload]
    rows = rows.select(*columns)

    def same_key():
        return reduce(
            operator.and_, [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, aliases)]
        )

    served = rows.join(F.broadcast(hot), same_key(), "left").drop(*aliases)
    is_hot = F.col("_hot").isNotNull()
    if keep is not None:
        served = served.select(*columns, "_hot", *[f"_hot.{p}" for p in payload])
        served = served.filter(~is_hot | keep).select(*columns, "_hot")
    served = served.withColumn(
        "_bucket", F.when(is_hot, -1 - bucket(spread)).otherwise(bucket(keys))
    )
    # <=> throughout: with = Spark would push "is not NULL" into this branch only
    same_bucket = F.col("_bucket").eqNullSafe(F.col("_cold_bucket"))
    joined = served.join(cold, same_key() & same_bucket, "left")
    # A weight is never zero. Asking for it keeps the column in this use of ``facts``
    # too; without it the two uses would be two plans and Spark would compute both.
    is_cold = F.col("_cold._weight") > 0
    joined = joined.select(
        *columns,
        *[
            F.when(is_hot, F.col(f"_hot.{p}"))
            .when(is_cold, F.col(f"_cold.{p}"))
            .alias(p)
            for p in payload
        ],
    )
    return joined.filter(keep) if keep is not None else joined
