"""Walk-forward folds: split table, membership, trainability, prior-rate scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEYS = ["train_start", "train_end", "validation_start", "validation_end"]


def walk_forward_splits(
    df: DataFrame, date: str, min_train: int, validation: int, step: int, max_splits: int | None = None
) -> DataFrame:
    """Split table (split_id and four dates). Widths count distinct dates, and training starts at the first date.

    Runs on the distinct dates only, so its unpartitioned window is as long as the calendar.
    """
    by_date = Window.partitionBy(F.lit(0)).orderBy("date")
    dates = df.where(F.col(date).isNotNull()).select(F.col(date).alias("date")).distinct()
    placed = dates.select(
        F.row_number().over(by_date).alias("position"),
        F.min("date").over(by_date).alias("train_start"),
        F.col("date").alias("train_end"),
        F.lead("date", 1).over(by_date).alias("validation_start"),
        F.lead("date", validation).over(by_date).alias("validation_end"),
    )
    chosen = placed.where(
        (F.col("position") >= min_train)
        & ((F.col("position") - min_train) % step == 0)
        & F.col("validation_end").isNotNull()
    ).withColumn("split_no", ((F.col("position") - min_train) / step).cast("int"))
    if max_splits is not None:
        chosen = chosen.where(F.col("split_no") < max_splits)
    return chosen.select(F.format_string("split_%02d", F.col("split_no")).alias("split_id"), *KEYS)


def _numbered(splits: DataFrame) -> DataFrame:
    """Splits with their number by the end of training. Calendar-sized."""
    return splits.withColumn("_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("train_end", "split_id")))


def fold_dates(df: DataFrame, splits: DataFrame, date: str) -> DataFrame:
    """(date, split_id, role): which dates train and which validate each split.

    Later splits start and end later, or at the same date. So the splits that hold a date are those from the first one
    that ends at or after it to the last one that starts at or before it: four numbers, read from growing frames over
    dates and borders together, which are calendar-sized. No date is compared with a split.
    """
    numbered = _numbered(splits)
    sides = {"train_start": "_ts", "train_end": "_te", "validation_start": "_vs", "validation_end": "_ve"}
    nothing = F.lit(None).cast("int")
    borders = numbered.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(side).alias("_date"),
                        *[(F.col("_no") if name == own else nothing).alias(name) for name in sides.values()],
                        F.lit(False).alias("_is_date"),
                    )
                    for side, own in sides.items()
                ]
            )
        )
    )
    dates = df.select(F.col(date).alias("_date")).where(F.col("_date").isNotNull()).distinct().select(
        "_date", *[nothing.alias(name) for name in sides.values()], F.lit(True).alias("_is_date")
    )
    calendar = Window.partitionBy(F.lit(0))
    until, since = calendar.orderBy(F.col("_date").asc()), calendar.orderBy(F.col("_date").desc())
    placed = dates.unionByName(borders).select(
        "_date", "_is_date",
        F.min("_te").over(since).alias("_first_train"), F.max("_ts").over(until).alias("_last_train"),
        F.min("_ve").over(since).alias("_first_check"), F.max("_vs").over(until).alias("_last_check"),
    ).where("_is_date")

    def held(first: str, last: str, role: str):
        numbers = F.when(F.col(first) <= F.col(last), F.sequence(first, last))
        return F.transform(F.coalesce(numbers, F.array().cast("array<int>")),
                           lambda no: F.struct(no.alias("_no"), F.lit(role).alias("role")))

    members = placed.select(
        F.col("_date").alias(date),
        F.inline(F.concat(held("_first_train", "_last_train", "train"), held("_first_check", "_last_check", "validation"))),
    )
    return members.join(numbered.select("_no", "split_id"), "_no").select("split_id", date, "role")


def fold_totals(per_date: DataFrame, splits: DataFrame, date: str, values: list[str]) -> DataFrame:
    """Totals of the values over the training and the validation dates of every split, as train_<v> and validation_<v>.

    One running total over the calendar, read at the four borders of each split; windows that grow cost nothing more.
    """
    empty = {value: F.lit(0).cast("long").alias(value) for value in values}
    sides = ["train_start", "train_end", "validation_start", "validation_end"]
    borders = splits.select(
        "split_id", F.inline(F.array(*[F.struct(F.col(side).alias("_date"), F.lit(side).alias("_side")) for side in sides]))
    ).select("_date", "split_id", "_side", *empty.values())
    missing = F.lit(None).cast("string")
    days = per_date.select(
        F.col(date).alias("_date"), missing.alias("split_id"), missing.alias("_side"),
        *[F.col(value).cast("long").alias(value) for value in values],
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("_date")  # rows of one date together
    of_day = Window.partitionBy("_date")
    summed = days.unionByName(borders).select(
        "split_id", "_side",
        *[F.sum(value).over(upto).alias(f"_to_{value}") for value in values],
        *[(F.sum(value).over(upto) - F.sum(value).over(of_day)).alias(f"_before_{value}") for value in values],
    ).where(F.col("split_id").isNotNull())

    def at(side: str, column: str):
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    return summed.groupBy("split_id").agg(
        *[
            (at(f"{role}_end", f"_to_{value}") - at(f"{role}_start", f"_before_{value}")).alias(f"{role}_{value}")
            for role in ("train", "validation") for value in values
        ]
    )


def fold_rows(df: DataFrame, splits: DataFrame, date: str, role: str | None = None) -> DataFrame:
    """Rows with their split_id and role, by an equi-join on the date. A row is in every fold that holds its date."""
    members = fold_dates(df, splits, date)
    if role is not None:
        members = members.where(F.col("role") == role)
    return df.join(members, date)


def fold_trainability(df: DataFrame, splits: DataFrame, date: str, prior_only: bool = False) -> DataFrame:
    """Counts per split and the reason why it cannot be trained (null if it can).

    Rows shrink to label counts per date before they meet the folds, so expanding windows cost nothing extra.
    """
    per_date = df.where(F.col("label").isNotNull()).groupBy(date).agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
    )
    totals = fold_totals(per_date, splits, date, ["positives", "negatives"])
    counted = totals.select(
        "split_id", F.col("train_positives").alias("train_positive_count"),
        F.col("train_negatives").alias("train_negative_count"),
        F.col("validation_positives").alias("validation_positive_count"),
        F.col("validation_negatives").alias("validation_negative_count"),
    ).withColumns(
        {
            "train_row_count": F.col("train_positive_count") + F.col("train_negative_count"),
            "validation_row_count": F.col("validation_positive_count") + F.col("validation_negative_count"),
        }
    )
    one_class = (F.col("train_positive_count") == 0) | (F.col("train_negative_count") == 0)
    reason = F.when(F.col("validation_row_count") == 0, "validation_fold_empty").when(
        F.col("train_row_count") == 0, "train_fold_empty"
    )
    if not prior_only:
        reason = reason.when(one_class, "train_fold_missing_classes")
    return counted.withColumn("skip_reason", reason)


def prior_rate_scores(df: DataFrame, splits: DataFrame, date: str) -> DataFrame:
    """Validation rows scored with the positive rate of their training slice."""
    per_date = df.groupBy(date).agg(F.sum("label").alias("_positives"), F.count("label").alias("_rows"))
    rates = fold_totals(per_date, splits, date, ["_positives", "_rows"]).select(
        "split_id", (F.col("train__positives") / F.col("train__rows")).alias("raw_score")
    )
    validating = fold_dates(df, splits, date).where(F.col("role") == "validation").join(rates, "split_id").drop("role")
    return df.join(validating, date)
