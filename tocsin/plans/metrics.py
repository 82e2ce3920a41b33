"""Exact classification metrics.

Everything is read from the *score table*: one row per group and distinct score with its positives and negatives.
Building it is one aggregate with map-side partials, so repeated scores (a constant baseline, a hot group) collapse
before the shuffle, and running totals over it need no single-task sort (see ``operators.running``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.functions.scoring import clip01
from tocsin.operators.running import running_totals

BINS = 5


def score_table(df: DataFrame, probability: str, label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per (group, clipped score)."""
    return df.groupBy(*groups, clip01(probability).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )


def cumulative_scores(scores: DataFrame, groups: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Score table with true and false positives at each score as the threshold."""
    return running_totals(scores, "score", ["positives", "negatives"], groups, ranges)


def precision_recall_curve(
    df: DataFrame, probability: str, label: str = "label", groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Threshold, precision and recall at every distinct score."""
    curve = cumulative_scores(score_table(df, probability, label, groups), groups, ranges)
    found = F.col("cum_positives") + F.col("cum_negatives")
    return curve.select(
        *groups,
        F.col("score").alias("threshold"),
        (F.col("cum_positives") / found).alias("precision"),
        F.when(F.col("all_positives") > 0, F.col("cum_positives") / F.col("all_positives")).alias("recall"),
    )


def _attach(df: DataFrame, per_group: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach one row per group (or a single row) to every row."""
    if not groups:
        columns = per_group.columns
        packed = per_group.select(F.struct(*columns).alias("s")).scalar()
        return df.withColumn("_s", packed).select(*df.columns, *[F.col("_s")[c].alias(c) for c in columns])
    renamed = per_group.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *[c for c in per_group.columns if c not in groups])
    condition = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups])
    return df.join(renamed, condition).drop(*[f"_g_{g}" for g in groups])


def _curve_aggregates() -> list[Column]:
    """Average precision, ROC AUC and top-k hit rate as aggregates over the cumulative table."""
    tp, fp = F.col("cum_positives"), F.col("cum_negatives")
    tied = F.col("positives") + F.col("negatives")
    step_precision = F.col("positives") * tp / (tp + fp)
    # Pairs won by the positives of this score: negatives below, and half of the ties.
    won = F.col("positives") * ((F.col("all_negatives") - fp) + F.col("negatives") / 2.0)
    k = F.greatest(F.col("all_positives"), F.lit(1))
    taken = F.greatest(F.least(k - (tp + fp - tied), tied), F.lit(0))
    hits = taken * F.col("positives") / tied
    p, n = F.max("all_positives"), F.max("all_negatives")
    return [
        F.when(p > 0, F.sum(step_precision) / p).alias("pr_auc"),
        F.when((p > 0) & (n > 0), F.sum(won) / (p.cast("double") * n.cast("double"))).alias("roc_auc"),
        (F.sum(hits) / F.least(F.greatest(p, F.lit(1)), p + n)).alias("top_k_risk_hit_rate"),
    ]


CURVE_METRICS = ["pr_auc", "roc_auc", "top_k_risk_hit_rate"]


def ranking_curve_metrics(
    df: DataFrame, probability: str, label: str = "label", groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """pr_auc, roc_auc and top_k_risk_hit_rate per group.

    Average precision is the step sum over distinct scores; ROC AUC counts ties as one half; the hit rate among
    the k highest scores (k = positives) takes a tied block at its boundary in proportion.
    """
    curve = cumulative_scores(score_table(df, probability, label, groups), groups, ranges)
    return curve.groupBy(*groups).agg(*_curve_aggregates())


def threshold_metrics(
    df: DataFrame, probability: str, label: str = "label", threshold: float = 0.5, groups: Sequence[str] = (),
    next_event: str | None = None, date: str | None = None,
) -> DataFrame:
    """Counts, precision, recall, F1, Brier score and lead times in one aggregate per group."""
    p = clip01(probability)
    predicted, actual = p >= threshold, F.col(label) == 1
    aggregates = [
        F.count("*").alias("row_count"),
        F.count_if(actual).alias("positive_count"),
        F.count_if(predicted & actual).alias("true_positives"),
        F.count_if(predicted & ~actual).alias("false_positives"),
        F.avg(F.pow(p - F.col(label), F.lit(2))).alias("brier_score"),
    ]
    if next_event and date:
        lead = F.when(predicted, F.datediff(F.col(next_event), F.col(date)))
        aggregates += [F.avg(lead).alias("mean_lead_days"), F.median(lead).alias("median_lead_days")]
    lead_columns = ["mean_lead_days", "median_lead_days"] if next_event and date else []
    return _rates(df.groupBy(*groups).agg(*aggregates), [*lead_columns], groups)


def _rates(counted: DataFrame, keep: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rates from the counts; a rate without cases is 0."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    positives, found = F.col("positive_count"), F.col("true_positives") + F.col("false_positives")
    return counted.select(
        *groups, "row_count", "positive_count",
        F.when(found > 0, tp / found).otherwise(0.0).alias("precision"),
        F.when(positives > 0, tp / positives).otherwise(0.0).alias("recall"),
        F.when(found + positives > 0, 2.0 * tp / (found + positives)).otherwise(0.0).alias("f1"),
        "brier_score",
        F.when(tp > 0, fp / tp).alias("false_positives_per_true_positive"),
        *keep,
    )


def classification_metrics(
    df: DataFrame, probability: str, label: str = "label", threshold: float = 0.5, groups: Sequence[str] = (),
    next_event: str | None = None, date: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """One row per group with all metrics but the calibration curve.

    All of them come from one score table; only lead times, if asked for, read the rows once more.
    """
    curve = cumulative_scores(score_table(df, probability, label, groups), groups, ranges)
    predicted = F.col("score") >= threshold
    squares = F.col("positives") * F.pow(1 - F.col("score"), F.lit(2)) + F.col("negatives") * F.pow("score", F.lit(2))
    counted = curve.groupBy(*groups).agg(
        F.max(F.col("all_positives") + F.col("all_negatives")).alias("row_count"),
        F.max("all_positives").alias("positive_count"),
        F.sum(F.when(predicted, F.col("positives")).otherwise(0)).alias("true_positives"),
        F.sum(F.when(predicted, F.col("negatives")).otherwise(0)).alias("false_positives"),
        (F.sum(squares) / F.max(F.col("all_positives") + F.col("all_negatives"))).alias("brier_score"),
        *_curve_aggregates(),
    )
    measured = _rates(counted, CURVE_METRICS, groups)
    if not (next_event and date):
        return measured
    lead = threshold_metrics(df, probability, label, threshold, groups, next_event, date)
    return _attach(measured, lead.select(*groups, "mean_lead_days", "median_lead_days"), groups)


ALL = "all"


def grouped_metrics(
    df: DataFrame, probability: str, group_columns: Sequence[str], label: str = "label", threshold: float = 0.5,
    within: Sequence[str] = (), overall: bool = False,
) -> DataFrame:
    """All metrics per value of each group column; rows are (group_column, group_value), for each key of ``within``.

    ``overall`` adds the group ("all", "all") of all rows. Groups are counted in one pass over the rows.
    """
    pairs = [
        F.struct(F.lit(column).alias("group_column"), F.col(column).cast("string").alias("group_value"))
        for column in group_columns if column in df.columns
    ]
    if overall:
        pairs.insert(0, F.struct(F.lit(ALL).alias("group_column"), F.lit(ALL).alias("group_value")))
    long = df.select(*within, F.col(probability), F.col(label), F.inline(F.array(*pairs)))
    known = long.where(F.col("group_value").isNotNull())
    return classification_metrics(known, probability, label, threshold, [*within, "group_column", "group_value"])


def calibration_curve(
    df: DataFrame, probability: str, label: str = "label", groups: Sequence[str] = (), bins: int = BINS,
    ranges: int | None = None,
) -> DataFrame:
    """Mean score and observed rate per quantile bin; a single row when only one class occurs.

    Bin edges are exact quantiles (linear interpolation), read as order statistics from running counts, so no
    task ever holds all scores.
    """
    scores = score_table(df, probability, label, groups).withColumn("rows", F.col("positives") + F.col("negatives"))
    placed = running_totals(
        scores, "score", ["rows", "positives", "negatives"], groups, ranges, descending=False
    ).withColumn("_two_classes", (F.col("all_positives") > 0) & (F.col("all_negatives") > 0))

    def order_statistic(position: Column) -> Column:
        inside = (F.col("cum_rows") - F.col("rows") <= position) & (position < F.col("cum_rows"))
        return F.max(F.when(inside, F.col("score")))

    edges: list[Column] = []
    for step in range(1, bins):
        position = (F.col("all_rows") - 1) * F.lit(step / bins)
        low = F.floor(position)
        edges += [
            order_statistic(low).alias(f"_low_{step}"),
            order_statistic(F.ceil(position)).alias(f"_high_{step}"),
            F.max(position - low).alias(f"_part_{step}"),
        ]
    bounds = placed.groupBy(*groups).agg(*edges)
    inner = [
        (F.col(f"_low_{s}") + (F.col(f"_high_{s}") - F.col(f"_low_{s}")) * F.col(f"_part_{s}")).alias(f"_edge_{s}")
        for s in range(1, bins)
    ]
    cut = _attach(placed, bounds.select(*groups, *inner), groups)
    above = reduce(lambda a, b: a + b, [(F.col("score") > F.col(f"_edge_{s}")).cast("int") for s in range(1, bins)])
    return (
        cut.withColumn("bin", F.when(F.col("_two_classes"), above).otherwise(0).cast("int"))
        .groupBy(*groups, "bin")
        .agg(
            (F.sum(F.col("score") * F.col("rows")) / F.sum("rows")).alias("predicted_bin_probability"),
            (F.sum("positives") / F.sum("rows")).alias("observed_rate"),
            F.sum("rows").alias("row_count"),
        )
    )


def probability_histogram(df: DataFrame, probability: str, groups: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Rows per equal-width bin on [0, 1]; the last bin is closed. Empty bins are left out."""
    index = F.least(F.floor(clip01(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*groups, index.alias("bin")).agg(F.count("*").alias("row_count"))


def lead_ties(df: DataFrame, score: str) -> DataFrame:
    """How many rows share the highest score."""
    top = df.agg(F.max(score)).scalar()
    return df.agg(F.max(score).alias("lead_score"), F.count_if(F.col(score) == top).alias("lead_tie_count"))


def model_comparison(metrics: DataFrame, baseline: str | None, model: str = "model_name") -> DataFrame:
    """Differences of each model to the baseline row and the best model by (PR-AUC, ROC-AUC, F1, -Brier)."""
    low = F.lit(float("-inf"))
    order = F.struct(
        F.coalesce("pr_auc", low), F.coalesce("roc_auc", low), F.coalesce("f1", low), F.coalesce(-F.col("brier_score"), low)
    )
    # The metric table has one row per model.
    everything = Window.partitionBy(F.lit(0))

    def of_baseline(column: str) -> Column:
        return F.max(F.when(F.col(model) == F.lit(baseline), F.col(column))).over(everything)

    return metrics.select(
        model,
        *[
            F.when(F.col(model) != F.lit(baseline), F.col(column) - of_baseline(column)).alias(f"delta_{column}")
            for column in ("pr_auc", "roc_auc", "f1", "brier_score")
        ],
        (F.max_by(model, order).over(everything) == F.col(model)).cast("int").alias("is_top_model"),
    )


def choose_baseline(available: Sequence[str], configured: str | None = None) -> str | None:
    """The configured baseline, else prior_rate if it was produced."""
    if configured is not None:
        if configured not in available:
            raise ValueError(f"Baseline model {configured} was not produced.")
        return configured
    return "prior_rate" if "prior_rate" in available else None
