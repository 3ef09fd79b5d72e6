"""Reader verdicts: records, counts and how well probabilities hold up against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayread.operators.digest import threshold_grid

LABEL_SCHEMA = (
    "ts long, url string, mode string, query string, text string, p double, role string, role_p double,"
    " correct boolean"
)


def label_record(judged: DataFrame, verdicts: DataFrame, mode: str) -> DataFrame:
    """Verdicts ``(ts, doc_id, question_id, idx, correct)`` joined with the items they are about."""
    items = judged.select("doc_id", "question_id", "idx", "url", "question", "text", "p", "role", "role_p")
    return verdicts.join(items, ["doc_id", "question_id", "idx"]).select(
        "ts", "url", F.lit(mode).alias("mode"), F.col("question").alias("query"), "text", "p", "role", "role_p", "correct"
    )


def label_counts(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*by).agg(
        F.count("*").alias("n_labels"),
        F.count_if("correct").alias("n_yes"),
        F.count_if(~F.col("correct")).alias("n_no"),
    )


def _bin(bins: int) -> Column:
    """Probability bin; the last one includes probability 1."""
    return F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")


def label_calibration(labels: DataFrame, bins: int = 10, by: Sequence[str] = ("mode", "role")) -> DataFrame:
    """Share of right items per probability bin; the last bin includes probability 1."""
    return (
        labels.where(F.col("p").isNotNull())
        .groupBy(*by, _bin(bins).alias("bin"))
        .agg(F.count("*").alias("n_labels"), F.count_if("correct").alias("n_yes"), F.avg("p").alias("mean_p"))
        .withColumn("precision", F.col("n_yes") / F.col("n_labels"))
    )


def label_thresholds(
    labels: DataFrame, thresholds: Sequence[float] | None = None, by: Sequence[str] = ("mode",)
) -> DataFrame:
    """Precision and recall of "at or above the threshold" against the verdicts, for every threshold."""
    grid = list(thresholds or threshold_grid())
    counts = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.count_if(F.col("p") >= t).alias("n_kept"),
            F.count_if((F.col("p") >= t) & F.col("correct")).alias("n_yes_kept"),
        )
        for t in grid
    ]
    return (
        labels.groupBy(*by)
        .agg(F.array(*counts).alias("rows"), F.count_if("correct").alias("n_yes"))
        .select(*by, "n_yes", F.inline("rows"))
        .withColumns(
            {
                "precision": F.col("n_yes_kept") / F.nullif("n_kept", F.lit(0)),
                "recall": F.col("n_yes_kept") / F.nullif("n_yes", F.lit(0)),
            }
        )
    )


def label_calibration_cube(labels: DataFrame, bins: int = 10) -> DataFrame:
    """Precision per probability bin for every mode and role, each mode, each role and all, in one aggregation.

    ``all_modes`` and ``all_roles`` say which are totals, as a role can be null in its own right.
    """
    binned = labels.where(F.col("p").isNotNull()).select("mode", "role", "correct", _bin(bins).alias("bin"))
    sets = [[F.col(c) for c in names] for names in (["mode", "role", "bin"], ["mode", "bin"], ["role", "bin"], ["bin"])]
    n_yes = F.count_if("correct")
    return binned.groupingSets(sets, F.col("mode"), F.col("role"), F.col("bin")).agg(
        (F.grouping("mode") == 1).alias("all_modes"), (F.grouping("role") == 1).alias("all_roles"),
        F.count("*").alias("n_labels"), n_yes.alias("n_yes"), (n_yes / F.count("*")).alias("precision"),
    )


def label_isotonic(labels: DataFrame, bins: int = 10, by: Sequence[str] = ("mode", "role")) -> DataFrame:
    """Precision per probability bin, and ``calibrated``: the closest values, by number of labels, that never fall with p.

    Counts of bins merge on each task first, so a group comes together as at most ``bins`` rows. Its fit is the greatest over all
    bins up to one's own of the least precision over spans from there to any bin from one's own on.
    """
    counts = labels.where(F.col("p").isNotNull()).groupBy(*by, _bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.count_if("correct").alias("yes"))
    held = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "yes"))).alias("held"))

    def total(name: str, j: Column, k: Column) -> Column:
        return F.aggregate(F.slice("held", j + 1, k - j + 1), F.lit(0).cast("long"), lambda a, x: a + x[name])

    def fitted(i: Column) -> Column:
        def least(j: Column) -> Column:
            return F.array_min(F.transform(F.sequence(i, F.size("held") - 1), lambda k: total("yes", j, k) / total("n", j, k)))

        return F.array_max(F.transform(F.sequence(F.lit(0), i), least))

    each = held.select(*by, "held", F.explode(F.sequence(F.lit(0), F.size("held") - 1)).alias("i")).withColumn("x", F.get("held", F.col("i")))
    return each.select(*by, "x.bin", F.col("x.n").alias("n_labels"), F.col("x.yes").alias("n_yes"), (F.col("x.yes") / F.col("x.n")).alias("precision"), fitted(F.col("i")).alias("calibrated"))
