"""Bloom filters inside the plan: built by a distributed aggregate, probed in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Bits beyond which a filter never grows (the engine's own default limit, 8 MB).
MAX_BITS = 64 * 1024 * 1024


def bits_for(items: int, fpp: float) -> int:
    """Bits for ``items`` keys at false-positive rate ``fpp``, capped at MAX_BITS."""
    wanted = math.ceil(-max(items, 1) * math.log(fpp) / math.log(2) ** 2)
    return max(1024, min(wanted, MAX_BITS))


def might_contain(keys: DataFrame, key: str, probe: str, items: int, fpp: float = 0.01) -> Column:
    """True where ``probe`` may be in ``keys[key]``, false where it surely is not.

    The filter is a scalar subquery of the plan, at most MAX_BITS large however many keys there
    are; beyond that size only the share of false positives grows. Without keys the answer is false.
    """
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = keys.sparkSession._jvm
    to = jvm.org.apache.spark.sql.classic.ExpressionUtils
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions

    def expression(column: Column):
        return to.expression(column._jc)

    limited = max(1, min(items, 4_000_000))
    aggregate = catalyst.aggregate.BloomFilterAggregate(
        expression(F.xxhash64(F.col(key))),
        expression(F.lit(limited).cast("bigint")),
        expression(F.lit(bits_for(items, fpp)).cast("bigint")),
    )
    built = keys.filter(F.col(key).isNotNull()).agg(ClassicColumn(to.column(aggregate.toAggregateExpression())).alias("bits"))
    contains = catalyst.BloomFilterMightContain(expression(built.scalar()), expression(F.xxhash64(F.col(probe))))
    return F.coalesce(ClassicColumn(to.column(contains)), F.lit(False))
