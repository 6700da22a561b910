"""Expressions that may raise, row by row."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def attempt(value: Column) -> Column:
    """``value``, or null in a row where it raises an error (of any kind: division, cast, index, ``raise_error``).

    This is the expression that Spark's own ``try_`` functions stand on; SQL has no name for it.
    """
    jvm = SparkSession.active()._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    # in a struct, as the optimiser would move the guard into the branches of a bare CASE and leave its conditions unguarded
    held = F.struct(value.alias("value"))
    return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.TryEval(utils.expression(held._jc))))["value"]
