"""Learning labels counted in rows per entity, ready-made labels, and the structural prior."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tocsin.operators.entity_windows import future_sum, lookback_sum, next_positive_date, ordered
from tocsin.operators.quality import require_columns, require_unique

ONSET, ESCALATION, THRESHOLD = "onset", "escalation", "threshold"


@dataclass(frozen=True)
class LabelDefinition:
    """How a label follows from the events after and before a row."""

    name: str
    kind: str
    source_column: str
    lookback_rows: int = 30
    forecast_threshold: float = 1.0
    quiet_threshold: float | None = None
    growth_multiplier: float = 1.0
    minimum_baseline: float = 0.0


# The ready-made targets.
TARGETS = {
    definition.name: definition
    for definition in (
        LabelDefinition(
            "organized_violence_onset", ONSET, "organized_violence_events", forecast_threshold=3.0, quiet_threshold=0.0
        ),
        LabelDefinition(
            "organized_violence_escalation", ESCALATION, "organized_violence_events",
            forecast_threshold=5.0, growth_multiplier=1.5,
        ),
        LabelDefinition(
            "major_unrest_escalation", ESCALATION, "protest_events", forecast_threshold=6.0, growth_multiplier=1.5
        ),
        LabelDefinition(
            "interstate_confrontation_risk", THRESHOLD, "interstate_tension_events", forecast_threshold=2.0
        ),
        LabelDefinition(
            "humanitarian_deterioration_risk", THRESHOLD, "humanitarian_displacement_flow", forecast_threshold=150.0
        ),
    )
}


def build_labels(
    df: DataFrame, definition: LabelDefinition, horizon: int, entity: str = "entity_id", date: str = "as_of_date"
) -> DataFrame:
    """Add label, next_event_date, lookback_sum and future_sum; all null where fewer than ``horizon`` rows follow."""
    require_columns(df, [entity, date, definition.source_column], "labels")
    spec = ordered(entity, date)
    value = F.col(definition.source_column).cast("double")
    framed = df.withColumns(
        {
            "future_sum": future_sum(value, horizon, spec),
            "_back": lookback_sum(value, definition.lookback_rows, spec),
            "next_event_date": next_positive_date(value, date, horizon, spec),
        }
    ).withColumn("lookback_sum", F.when(F.col("future_sum").isNotNull(), F.col("_back")))
    back, ahead = F.col("lookback_sum"), F.col("future_sum")
    if definition.kind == ONSET:
        hit = (back <= (definition.quiet_threshold or 0.0)) & (ahead >= definition.forecast_threshold)
    elif definition.kind == ESCALATION:
        baseline = F.greatest(back, F.lit(float(definition.minimum_baseline)))
        hit = ahead >= F.greatest(F.lit(float(definition.forecast_threshold)), baseline * definition.growth_multiplier)
    elif definition.kind == THRESHOLD:
        hit = ahead >= definition.forecast_threshold
    else:
        raise ValueError(f"Unknown label kind: {definition.kind}")
    return framed.select(
        *df.columns, hit.cast("long").alias("label"), "next_event_date", "lookback_sum", "future_sum"
    )


def labeled_rows(df: DataFrame) -> DataFrame:
    """Rows whose label is known."""
    return df.where(F.col("label").isNotNull())


def attach_labels(df: DataFrame, labels: DataFrame, entity: str, date: str) -> DataFrame:
    """Join labels of another table, one per row, and keep labeled rows."""
    require_unique(labels, [entity, date], "labels")
    return labeled_rows(df.join(labels, [entity, date], "left"))


def precomputed_labels(df: DataFrame, label_column: str, next_event_date_column: str | None = None) -> DataFrame:
    """Use a label column of the table itself; rows without it are dropped."""
    require_columns(df, [label_column, *([next_event_date_column] if next_event_date_column else [])], "labels")
    next_date = F.col(next_event_date_column) if next_event_date_column else F.lit(None)
    return df.where(F.col(label_column).isNotNull()).withColumns(
        {"label": F.col(label_column).cast("long"), "next_event_date": next_date.cast("date")}
    )


def attach_prior(
    df: DataFrame, scores: DataFrame, entity: str, date: str, *, score_entity: str = "entity_id",
    score_date: str = "forecast_date", score: str = "calibrated_probability", feature: str = "structural_prior_score",
) -> DataFrame:
    """Left join the scores of a slower model as a feature; repeated (entity, date) scores are an error."""
    require_columns(scores, [score_entity, score_date, score], "structural prior")
    slim = scores.select(
        F.col(score_entity).alias(entity), F.col(score_date).cast("date").alias(date), F.col(score).alias(feature)
    ).where(F.col(entity).isNotNull() & F.col(date).isNotNull())
    return df.join(require_unique(slim, [entity, date], "structural prior"), [entity, date], "left")


def label_distribution(df: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows, positives, negatives and number of classes among labeled rows."""
    return (
        labeled_rows(df)
        .groupBy(*groups)
        .agg(
            F.count("*").alias("row_count"),
            F.count_if(F.col("label") == 1).alias("positive_count"),
            F.count_if(F.col("label") == 0).alias("negative_count"),
            F.count_distinct("label").alias("class_count"),
        )
    )
