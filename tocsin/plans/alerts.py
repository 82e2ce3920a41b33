"""Alert episodes, their evaluation, ranking metrics and the operating threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.functions.scoring import CLEAR_LEAD_MARGIN
from tocsin.operators.entity_windows import episodes
from tocsin.operators.running import running_totals

ENTITY, DATE, PROBABILITY, LABEL = "entity_id", "forecast_date", "calibrated_probability", "label"


def _day(column: str = DATE) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def _from_now(entity: str = ENTITY):
    """Rows of the entity dated on or after the current row: a growing frame from the newest day down, so each row is
    added once (a frame that ends at the last row is summed anew for every row)."""
    return Window.partitionBy(entity).orderBy(F.col("_day").desc()).rangeBetween(Window.unboundedPreceding, 0)


def _until_now(entity: str = ENTITY):
    """Rows of the entity dated on or before the current row."""
    return Window.partitionBy(entity).orderBy("_day").rangeBetween(Window.unboundedPreceding, 0)


def alert_table(predictions: DataFrame, threshold: float | Column, gap_days: int) -> DataFrame:
    """Predictions with alert and label episodes, outcome and lead days of each alert.

    An alert is true when the entity has any positive row on or after its date. ``recalled`` marks the start of a
    label episode that an alert preceded or met; any such alert is true, because the positive follows it.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    dated = predictions.withColumn(DATE, F.col(DATE).cast("date")).withColumn(
        "is_alert", (F.col(PROBABILITY) >= limit).cast("int")
    )
    with_alerts = episodes(dated, F.col("is_alert") == 1, ENTITY, DATE, gap_days, "alert")
    both = episodes(with_alerts, F.col(LABEL) == 1, ENTITY, DATE, gap_days, "label")
    base = both.withColumn("_day", _day())
    searched = base.withColumns(
        {
            "_next_positive": F.min(F.when(F.col(LABEL) == 1, F.col(DATE))).over(_from_now()),
            "_alerted": F.max("is_alert").over(_until_now()),
        }
    )
    alert, ahead = F.col("is_alert") == 1, F.col("_next_positive")
    return searched.select(
        *dated.columns,
        "alert_episode_id",
        "label_episode_id",
        "is_new_alert",
        F.col("is_new_label").alias("is_new_label_episode"),
        F.when(alert, F.when(ahead.isNotNull(), "true_alert").otherwise("false_alert")).alias("alert_outcome"),
        F.when(alert, F.datediff(ahead, F.col(DATE)).cast("long")).alias("lead_days_to_positive_label"),
        F.when(F.col("is_new_label") == 1, F.col("_alerted")).alias("recalled"),
    )


def alert_summary(alerts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row of alert metrics (per group)."""
    fresh = F.col("is_new_alert") == 1
    true_alert = fresh & (F.col("alert_outcome") == "true_alert")
    false_alert = fresh & (F.col("alert_outcome") == "false_alert")
    lead = F.when(true_alert, F.col("lead_days_to_positive_label"))
    counted = alerts.groupBy(*groups).agg(
        F.count_if(fresh).alias("new_alert_count"),
        F.coalesce(F.sum("is_new_label_episode"), F.lit(0)).alias("new_label_episode_count"),
        F.count_if(true_alert).alias("true_alert_count"),
        F.count_if(false_alert).alias("false_alert_count"),
        F.coalesce(F.sum("recalled"), F.lit(0)).alias("_recalled"),
        F.avg(lead).alias("first_alert_lead_days_mean"),
        F.median(lead).alias("first_alert_lead_days_median"),
    )
    return counted.select(
        *groups,
        "new_alert_count",
        "new_label_episode_count",
        "true_alert_count",
        "false_alert_count",
        F.when(F.col("new_label_episode_count") > 0, F.col("_recalled") / F.col("new_label_episode_count")).alias(
            "episode_recall"
        ),
        "first_alert_lead_days_mean",
        "first_alert_lead_days_median",
        F.col("false_alert_count").alias("false_alert_burden"),
        F.when(F.col("true_alert_count") > 0, F.col("false_alert_count") / F.col("true_alert_count")).alias(
            "false_alerts_per_true_alert"
        ),
    )


def recalled_episodes(episode_starts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Episode starts that a true alert of the same entity preceded or met.

    The first true alert of an entity decides, so the alert side is one row per entity.
    """
    first = (
        alerts.where((F.col("is_alert") == 1) & (F.col("alert_outcome") == "true_alert"))
        .groupBy(F.col(ENTITY))
        .agg(F.min(DATE).alias("_first_alert"))
    )
    return (
        episode_starts.join(first, ENTITY)
        .where(F.col("_first_alert") <= F.col(DATE))
        .drop("_first_alert")
    )


def threshold_sweep(predictions: DataFrame, gap_days: int, ranges: int | None = None) -> DataFrame:
    """Alert counts and episode recall at every distinct score as the threshold.

    No threshold is tried one by one. A row starts an alert exactly for thresholds in (m, s]: s is its own score
    and m the highest score of its entity in the ``gap_days`` before it. Its outcome does not depend on the
    threshold. An episode start is recalled for every threshold up to the highest score seen so far. So one pass
    over each entity's rows yields steps at scores, and running totals over the distinct scores yield the counts
    for all thresholds at once.
    """
    score = F.col(PROBABILITY).cast("double")
    dated = predictions.select(
        ENTITY, F.col(DATE).cast("date").alias(DATE), score.alias("_score"), (F.col(LABEL) == 1).alias("_positive")
    ).withColumn("_day", _day())
    recent = Window.partitionBy(ENTITY).orderBy("_day").rangeBetween(min(-gap_days, -1), -1)
    recent_best = F.max("_score").over(recent) if gap_days >= 1 else F.lit(None).cast("double")
    earlier = Window.partitionBy(ENTITY).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    previous_positive = F.max(F.when(F.col("_positive"), F.col(DATE))).over(earlier)
    rows = dated.select(
        "_score",
        recent_best.alias("_recent_best"),
        F.max(F.when(F.col("_positive"), 1)).over(_from_now()).isNotNull().alias("_true"),
        F.max("_score").over(_until_now()).alias("_best"),
        (
            F.col("_positive")
            & (previous_positive.isNull() | (F.datediff(F.col(DATE), previous_positive) > gap_days))
        ).alias("_episode_start"),
    )
    starts = F.col("_recent_best").isNull() | (F.col("_recent_best") < F.col("_score"))
    true_step, false_step = F.col("_true").cast("long"), (~F.col("_true")).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(at: Column, true: Column, false: Column, recalled: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(at.alias("score"), true.alias("true_alerts"), false.alias("false_alerts"), recalled.alias("recalled")),
        )

    steps = F.array_compact(
        F.array(
            step(F.col("_score"), true_step, false_step, zero, starts),
            step(F.col("_score"), zero, zero, zero, ~starts),
            step(F.col("_recent_best"), -true_step, -false_step, zero, starts & F.col("_recent_best").isNotNull()),
            step(F.col("_best"), zero, zero, one, F.col("_episode_start")),
        )
    )
    values = ["true_alerts", "false_alerts", "recalled"]
    table = rows.select(F.inline(steps)).groupBy("score").agg(*[F.sum(value).alias(value) for value in values])
    counted = running_totals(table, "score", values, ranges=ranges)
    # Every episode is recalled at the lowest threshold, so the total of the recall steps is the episode count.
    return counted.select(
        F.col("score").alias("threshold"),
        F.when(F.col("all_recalled") > 0, F.col("cum_recalled") / F.col("all_recalled")).alias("episode_recall"),
        F.col("cum_true_alerts").alias("true_alert_count"),
        F.col("cum_false_alerts").alias("false_alert_count"),
    )


def operating_threshold(predictions: DataFrame, gap_days: int) -> DataFrame:
    """Best threshold by episode recall, then true alerts, fewest false alerts, highest threshold (one row)."""
    sweep = threshold_sweep(predictions, gap_days)
    order = F.struct(
        F.coalesce("episode_recall", F.lit(-1.0)), F.col("true_alert_count"), -F.col("false_alert_count"), F.col("threshold")
    )
    best = sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("best")).select("best.*")
    return best.select(
        F.coalesce("threshold", F.lit(0.5)).alias("publish_threshold"),
        F.coalesce("threshold", F.lit(0.5)).alias("alert_threshold"),
        "episode_recall",
        F.coalesce("true_alert_count", F.lit(0)).alias("true_alert_count"),
        F.coalesce("false_alert_count", F.lit(0)).alias("false_alert_count"),
    )


def date_leaders(predictions: DataFrame, depth: int, groups: Sequence[str] = ()) -> DataFrame:
    """The ``depth`` highest scores of each date with their position; ties by entity.

    The filter on the row number keeps at most ``depth`` rows per date and task before the shuffle.
    """
    order = Window.partitionBy(*groups, DATE).orderBy(F.col(PROBABILITY).desc(), F.col(ENTITY).asc())
    return predictions.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= depth)


def ranking_metrics(
    predictions: DataFrame, publish_threshold: float | Column, top_k: Sequence[int] = (5, 10),
    margin: float = CLEAR_LEAD_MARGIN,
) -> DataFrame:
    """Recall among the k highest scores of each date, and how often a date has no clear leader."""
    limit = publish_threshold if isinstance(publish_threshold, Column) else F.lit(float(publish_threshold))
    leaders = date_leaders(predictions.withColumn(DATE, F.col(DATE).cast("date")), max(2, *top_k))
    per_date = leaders.groupBy(DATE).agg(
        F.max(F.when(F.col("_place") == 1, F.col(PROBABILITY))).alias("_first"),
        F.max(F.when(F.col("_place") == 2, F.col(PROBABILITY))).alias("_second"),
        *[F.sum(F.when(F.col("_place") <= k, F.col(LABEL)).otherwise(0)).alias(f"_hits_{k}") for k in top_k],
    )
    positives = predictions.agg(F.sum(LABEL)).scalar()
    unclear = (F.col("_first") < limit) | F.coalesce((F.col("_first") - F.col("_second")) < margin, F.lit(False))
    return per_date.agg(
        F.avg(unclear.cast("double")).alias("no_clear_leader_rate"), *[F.sum(f"_hits_{k}").alias(f"_hits_{k}") for k in top_k]
    ).select(
        "no_clear_leader_rate",
        *[F.when(positives > 0, F.col(f"_hits_{k}") / positives).alias(f"recall_at_{k}") for k in top_k],
    )


def replay(predictions: DataFrame, alerts: DataFrame, entity: str, model: str, rows: int) -> DataFrame:
    """Newest rows of one entity and model with their alert outcome."""
    chosen = predictions.where((F.col(ENTITY) == entity) & (F.col("model_name") == model))
    outcomes = alerts.where(F.col(ENTITY) == entity).select(ENTITY, DATE, "is_alert", "alert_outcome")
    return chosen.join(outcomes, [ENTITY, DATE], "left").orderBy(F.col(DATE).desc()).limit(rows)
