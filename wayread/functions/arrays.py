"""Small building blocks for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it many times."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, first: Column) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("out"), first.alias("total"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct(
            F.concat(acc["out"], F.array(acc["total"])).alias("out"), (acc["total"] + v).alias("total")
        ),
        lambda acc: acc["out"],
    )


def prefix_sums(values: Column, step: int = 256) -> Column:
    """Exclusive running sums of an int array.

    Appending to an array copies it, so a single pass over n values costs n*n. Values are summed in
    runs of ``step`` and the runs are shifted afterwards, which keeps very long arrays cheap too.
    """

    def in_runs(vs: Column) -> Column:
        n_runs = F.ceil(F.size(vs) / F.lit(step)).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), n_runs - 1), lambda k: F.slice(vs, k * F.lit(step) + 1, F.lit(step))
        )

        def shift(rs: Column) -> Column:
            totals = F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda a, v: a + v))
            return F.flatten(F.zip_with(rs, _running(totals, F.lit(0)), _running))

        return let(runs, shift)

    return let(
        values,
        lambda vs: F.when(F.size(vs) <= step, _running(vs, F.lit(0))).otherwise(in_runs(vs)),
    )
