"""Day-range windows, as-of values and nearest dates on a weekly grid.

Raw rows are never windowed. Every source first shrinks to *cells*: one row per entity and Monday, built by an
aggregate with map-side partials, so that an entity holding a third of all rows still contributes at most one
row per week and task. Cells of all sources are then stacked on the panel skeleton and one window pass per
entity (a few thousand rows each, whatever the size of the sources) reads every feature.

A day ``d`` belongs to the cell of its closing Monday ``m`` at offset ``o = m - d`` (0..6). A day range
``w+lo .. w+hi`` around Monday ``w`` is therefore a run of whole cells plus at most one partial cell on each
side; partial cells keep their own totals, restricted to the offsets that are inside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tocsin.functions.calendar import closing_monday, week_number, week_sequence, week_start

ENTITY, WEEK, WEEK_NO, IS_PANEL = "entity_id", "week_start_date", "_week_no", "_is_panel"


# --- skeleton ---------------------------------------------------------------------------------------------


def weekly_calendar(bounds: DataFrame) -> DataFrame:
    """Mondays between ``start_date`` and ``end_date`` of a one-row frame."""
    return bounds.select(F.explode(week_sequence("start_date", "end_date")).alias(WEEK))


def dense_panel(dimension: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every entity of the dimension with every week from start to end.

    The weeks are generated inside each row, so the expansion needs neither a join nor a shuffle.
    """
    return dimension.withColumn(WEEK, F.explode(week_sequence(start, end)))


def entity_weeks(rows: DataFrame, entity: str, day: str) -> DataFrame:
    """Distinct (entity, week) pairs of the rows, by calendar week."""
    return (
        rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(F.col(entity).alias(ENTITY), week_start(day).alias(WEEK))
        .distinct()
    )


def panel_bounds(dated: Sequence[tuple[DataFrame, str]], yearly: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """One row with the earliest week over all sources (``start_date``)."""
    parts = [frame.agg(week_start(F.min(column)).alias("start_date")) for frame, column in dated]
    parts += [
        frame.agg(week_start(F.make_date(F.min(column).cast("int"), F.lit(1), F.lit(1))).alias("start_date"))
        for frame, column in yearly
    ]
    return reduce(DataFrame.unionByName, parts).agg(F.min("start_date").alias("start_date"))


# --- day-range sums ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DayRange:
    """Days ``w+lo .. w+hi`` around the Monday ``w``."""

    lo: int
    hi: int

    def whole(self) -> tuple[int, int] | None:
        """First and last cell (in weeks from ``w``) that lie inside completely."""
        first, last = -((-self.lo - 6) // 7), self.hi // 7
        return (first, last) if first <= last else None

    def partial(self) -> list[tuple[int, int, int]]:
        """Cells cut by a border: (weeks from ``w``, smallest offset, largest offset)."""
        whole = self.whole()
        cut = []
        for week in range(-(-self.lo // 7), (self.hi + 6) // 7 + 1):
            if whole and whole[0] <= week <= whole[1]:
                continue
            least, most = max(0, 7 * week - self.hi), min(6, 7 * week - self.lo)
            if least <= most:
                cut.append((week, least, most))
        return cut


TRAILING_7D, TRAILING_28D, TRAILING_56D = DayRange(-6, 0), DayRange(-27, 0), DayRange(-55, 0)
HISTORY_52W = DayRange(-364, 0)
FUTURE_7D, FUTURE_30D, FUTURE_90D = DayRange(1, 7), DayRange(1, 30), DayRange(1, 90)


@dataclass(frozen=True)
class RangeSum:
    """Sum of ``value`` (a column of the source; None counts rows) over a day range."""

    name: str
    days: DayRange
    value: str | None = None


def _cell_names(measure: RangeSum) -> list[tuple[str, int, int, int, int]]:
    """Cell columns behind a measure: (column, first week, last week, least offset, most offset)."""
    base = measure.value or "rows"
    names = []
    whole = measure.days.whole()
    if whole:
        names.append((f"_sum_{base}", whole[0], whole[1], 0, 6))
    for week, least, most in measure.days.partial():
        names.append((f"_sum_{base}_{least}_{most}", week, week, least, most))
    return names


def sum_cells(
    rows: DataFrame, entity: str | None, day: str, measures: Sequence[RangeSum], prefix: str,
    by: dict[str, Column] | None = None, plain: dict[str, Column] | None = None, placed: bool = True,
) -> DataFrame:
    """Cells with the totals that the measures need; null values count as zero.

    ``by`` splits a cell further: windows add its parts up again. ``plain`` are aggregates under their own names.
    ``placed``: rows without an entity are left out.
    """
    known = rows.where(F.col(day).isNotNull())
    if entity is not None and placed:
        known = known.where(F.col(entity).isNotNull())
    monday = closing_monday(day)
    offset = F.datediff(monday, F.col(day).cast("date"))
    aggregates: dict[str, Column] = {}
    for measure in measures:
        value = F.lit(1).cast("long") if measure.value is None else F.coalesce(F.col(measure.value), F.lit(0))
        for column, _, _, least, most in _cell_names(measure):
            inside = value if (least, most) == (0, 6) else F.when(offset.between(least, most), value)
            aggregates[prefix + column] = F.sum(inside).alias(prefix + column)
    keys = ([F.col(entity).alias(ENTITY)] if entity is not None else []) + [monday.alias(WEEK)]
    keys += [column.alias(name) for name, column in (by or {}).items()]
    further = [column.alias(name) for name, column in (plain or {}).items()]
    return known.groupBy(*keys).agg(*aggregates.values(), *further)


def distinct_cells(
    rows: DataFrame, entity: str, day: str, columns: dict[str, str], week: Callable[[str], Column] = closing_monday
) -> DataFrame:
    """Distinct non-null values per entity and week, exact: a column ``name`` for each name -> column.

    Every value shrinks to one row per entity and week first, in an aggregate with partials on the map side; those rows
    are then counted. All columns share both steps, and nothing is expanded beside their sums.
    """
    named = F.array(
        *[F.struct(F.lit(name).alias("_of"), F.col(column).cast("string").alias("_value")) for name, column in columns.items()]
    )
    known = rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    values = known.select(F.col(entity).alias(ENTITY), week(day).alias(WEEK), F.inline(named))
    once = values.where(F.col("_value").isNotNull()).distinct()
    return once.groupBy(ENTITY, WEEK).agg(*[F.count_if(F.col("_of") == name).alias(name) for name in columns])


@dataclass(frozen=True)
class RangeDistinct:
    """Distinct values of a column over a day range, estimated by sketches of 2 ** lg_k counters.

    Sketches of cells merge, so a long range costs no more rows than a short one. The standard error is about
    1.04 / sqrt(2 ** lg_k): 1.6 % for 12.
    """

    name: str
    days: DayRange
    value: str
    lg_k: int = 12

    def _parts(self) -> list[tuple[str, int, int, int, int]]:
        cells = _cell_names(RangeSum(self.name, self.days, self.value))
        return [(column.replace("_sum_", "_hll_"), *rest) for column, *rest in cells]


def sketch_columns(measures: Sequence[RangeDistinct], day: str, prefix: str) -> dict[str, Column]:
    """Aggregates of cells (``plain`` of ``sum_cells``) that the measures need."""
    offset = F.datediff(closing_monday(day), F.col(day).cast("date"))
    found: dict[str, Column] = {}
    for measure in measures:
        value = F.col(measure.value).cast("string")
        for column, _, _, least, most in measure._parts():
            inside = value if (least, most) == (0, 6) else F.when(offset.between(least, most), value)
            found[prefix + column] = F.hll_sketch_agg(inside, measure.lg_k)
    return found


def range_distinct_estimate(measure: RangeDistinct, prefix: str, partition: Sequence[str] = ()) -> Column:
    """Estimated number of distinct values at each stacked row; zero when no row is in range."""
    merged = [
        F.hll_union_agg(prefix + column).over(_frame(first, last, partition or (ENTITY,)))
        for column, first, last, _, _ in measure._parts()
    ]
    whole = merged[0]
    for part in merged[1:]:
        # A frame without rows has an empty sketch of the default size.
        whole = F.coalesce(F.hll_union(whole, part, True), whole, part)
    return F.coalesce(F.hll_sketch_estimate(whole), F.lit(0))


def _frame(first: int | None, last: int, partition: Sequence[str]) -> WindowSpec:
    spec = Window.partitionBy(*partition).orderBy(WEEK_NO)
    return spec.rangeBetween(Window.unboundedPreceding if first is None else first, last)


def range_sum(measure: RangeSum, prefix: str, partition: Sequence[str] = (ENTITY,)) -> Column:
    """Total of a measure at each stacked row; zero when no row is in range."""
    parts = [
        F.coalesce(F.sum(prefix + column).over(_frame(first, last, partition)), F.lit(0))
        for column, first, last, _, _ in _cell_names(measure)
    ]
    return reduce(lambda left, right: left + right, parts)


def cell_value(name: str, partition: Sequence[str] = (ENTITY,)) -> Column:
    """Value of a cell column for the 7 days that end on the row's Monday."""
    return F.max(name).over(_frame(0, 0, partition))


# --- as-of and nearest dates ------------------------------------------------------------------------------


def asof_cells(
    rows: DataFrame, entity: str | None, day: Column, columns: Sequence[str], name: str,
    tie_break: Sequence[str] = (), plain: dict[str, Column] | None = None, placed: bool = True,
) -> DataFrame:
    """Newest observation per cell as a struct; on the same day the largest tie-break (or values) wins.

    Annual observations are dated January 1st, which makes "latest year not after the week's year" the same
    search as "latest day not after the week". ``plain`` are further aggregates, over ``_day`` too; without ``placed``
    rows without a day or an entity have cells as well, which hold no observation.
    """
    keyed = rows.withColumn("_day", day)
    if placed:
        keyed = keyed.where(F.col("_day").isNotNull())
        keyed = keyed.where(F.col(entity).isNotNull()) if entity is not None else keyed
    dated = F.col("_day").isNotNull()
    order = F.when(dated, F.struct("_day", *[F.col(column) for column in (tie_break or columns)]))
    keys = ([F.col(entity).alias(ENTITY)] if entity is not None else []) + [closing_monday("_day").alias(WEEK)]
    newest = F.max_by(F.when(dated, F.struct("_day", *columns)), order).alias(name)
    return keyed.groupBy(*keys).agg(newest, *[column.alias(key) for key, column in (plain or {}).items()])


def year_day(year: str) -> Column:
    """January 1st of a year column."""
    return F.make_date(F.col(year).cast("int"), F.lit(1), F.lit(1))


def asof_value(name: str, partition: Sequence[str] = (ENTITY,)) -> Column:
    """Whole newest observation at or before the row's Monday, nulls inside it included."""
    return F.last(name, ignorenulls=True).over(_frame(None, 0, partition))


def date_cells(
    rows: DataFrame, entity: str, day: str, prefix: str, plain: dict[str, Column] | None = None, placed: bool = True
) -> DataFrame:
    """Cells of a calendar: newest date per closing Monday and oldest date per starting Monday.

    ``plain`` and ``placed`` as in ``asof_cells``.
    """
    if placed:
        rows = rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    sides = F.array(
        F.struct(closing_monday(day).alias(WEEK), F.col(day).alias("_past"), F.lit(None).cast("date").alias("_next")),
        F.struct(week_start(day).alias(WEEK), F.lit(None).cast("date").alias("_past"), F.col(day).alias("_next")),
    )
    return (
        rows.select("*", F.col(day).alias("_day"), F.inline(sides))
        .groupBy(F.col(entity).alias(ENTITY), WEEK)
        .agg(
            F.max("_past").alias(f"{prefix}_past"), F.min("_next").alias(f"{prefix}_next"),
            *[column.alias(key) for key, column in (plain or {}).items()],
        )
    )


def last_date(prefix: str) -> Column:
    """Newest date at or before the row's Monday."""
    return F.max(f"{prefix}_past").over(_frame(None, 0, (ENTITY,)))


def next_date(prefix: str) -> Column:
    """Oldest date at or after the row's Monday: a growing frame from the newest week down."""
    downwards = Window.partitionBy(ENTITY).orderBy(F.col(WEEK_NO).desc())
    return F.min(f"{prefix}_next").over(downwards.rangeBetween(Window.unboundedPreceding, 0))


def latest_row_asof(rows: DataFrame, entity: str | None, day: str, cutoff: Column) -> DataFrame:
    """Single newest row at or before the cut-off, per entity or overall."""
    others = [column for column in rows.columns if column != entity]
    known = rows.where(F.col(day) <= cutoff)
    order = F.struct(F.col(day), *[F.col(column) for column in others if column != day])
    newest = F.max_by(F.struct(*others), order).alias("_newest")
    grouped = known.groupBy(entity).agg(newest) if entity is not None else known.agg(newest)
    return grouped.where(F.col("_newest").isNotNull()).select(*([entity] if entity is not None else []), "_newest.*")


# --- one pass over everything -----------------------------------------------------------------------------


def stack_cells(panel: DataFrame, cells: Sequence[DataFrame]) -> DataFrame:
    """Panel rows and cells of all sources in one frame; cells outside the panel still feed its windows."""
    marked = panel.withColumn(IS_PANEL, F.lit(True))
    united = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), cells, marked)
    return united.withColumn(WEEK_NO, week_number(WEEK))


def read_panel(stacked: DataFrame, columns: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Evaluate window columns over the stacked rows and keep the panel rows."""
    return (
        stacked.select(*keep, IS_PANEL, *[column.alias(name) for name, column in columns.items()])
        .where(F.col(IS_PANEL))
        .drop(IS_PANEL)
    )


def range_sums(panel: DataFrame, rows: DataFrame, entity: str, day: str, measures: Sequence[RangeSum]) -> DataFrame:
    """Day-range sums of one source for every panel row."""
    stacked = stack_cells(panel, [sum_cells(rows, entity, day, measures, "c")])
    return read_panel(stacked, {m.name: range_sum(m, "c") for m in measures}, panel.columns)


def asof_join(
    panel: DataFrame, rows: DataFrame, entity: str, day: Column, columns: Sequence[str],
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Panel rows with the columns of the newest observation at or before their week."""
    stacked = stack_cells(panel, [asof_cells(rows, entity, day, columns, "_asof", tie_break)])
    read = read_panel(stacked, {"_row": asof_value("_asof")}, panel.columns)
    return read.select(*panel.columns, *[F.col("_row")[column].alias(column) for column in columns])


def asof_global(
    calendar: DataFrame, rows: DataFrame, day: Column, columns: Sequence[str], tie_break: Sequence[str] = ()
) -> DataFrame:
    """Weeks with the newest observation at or before each. Calendar-sized: at most one row per week."""
    cells = asof_cells(rows, None, day, columns, "_asof", tie_break)
    stacked = stack_cells(calendar.withColumn("_all", F.lit(0)), [cells.withColumn("_all", F.lit(0))])
    read = read_panel(stacked, {"_row": asof_value("_asof", ("_all",))}, calendar.columns)
    return read.select(*calendar.columns, *[F.col("_row")[column].alias(column) for column in columns])


def nearest_dates(panel: DataFrame, calendar: DataFrame, entity: str, day: str) -> DataFrame:
    """Panel rows with the next calendar date (>= week) and the last one (<= week)."""
    stacked = stack_cells(panel, [date_cells(calendar, entity, day, "d")])
    return read_panel(stacked, {"next_date": next_date("d"), "last_date": last_date("d")}, panel.columns)


# --- fan-out ----------------------------------------------------------------------------------------------


def fan_out(rows: DataFrame, day: str, days: DayRange) -> DataFrame:
    """Each row once per Monday whose day range holds it (at most 1 + length / 7 copies)."""
    first = closing_monday(F.date_sub(day, days.hi))
    last = week_start(F.date_sub(day, days.lo))
    mondays = F.when(first <= last, F.sequence(first, last, F.expr("interval 7 days")))
    return rows.withColumn(WEEK, F.explode(mondays))


def range_distinct(rows: DataFrame, entity: str, day: str, value: str, days: DayRange, name: str) -> DataFrame:
    """Distinct non-null values per entity and week over a day range.

    Distinct counts do not add up over cells. Every row counts for a run of Mondays; of one entity and value, a run is cut
    where the run before it ends, so that no Monday is held twice. A value then adds one where a run starts and takes one
    away where it ends, and a running total over the weeks of an entity gives the number. A long range costs no more rows
    than a short one. Rows are spread by entity and value; only their changes per week meet by entity.
    """
    at = F.col(day).cast("date")
    runs = (
        rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull())
        .select(
            F.col(entity).alias(ENTITY), F.col(value).alias("_value"),
            closing_monday(F.date_sub(at, days.hi)).alias("_first"), week_start(F.date_sub(at, days.lo)).alias("_last"),
        )
        .where(F.col("_first") <= F.col("_last"))
        .distinct()
    )
    # Both ends grow with the day: the run before ends last of all earlier ones.
    before = F.lag("_last").over(Window.partitionBy(ENTITY, "_value").orderBy("_first", "_last"))
    start = F.coalesce(F.greatest(F.col("_first"), F.date_add(before, 7)), F.col("_first"))
    cut = runs.select(ENTITY, start.alias("_first"), "_last").where(F.col("_first") <= F.col("_last"))
    borders = F.array(
        F.struct(F.col("_first").alias(WEEK), F.lit(1).cast("long").alias("_change")),
        F.struct(F.date_add("_last", 7).alias(WEEK), F.lit(-1).cast("long").alias("_change")),
    )
    changes = cut.select(ENTITY, F.inline(borders)).groupBy(ENTITY, WEEK).agg(F.sum("_change").alias("_change"))
    weeks = Window.partitionBy(ENTITY).orderBy(WEEK)
    counted = changes.select(
        ENTITY, WEEK, F.sum("_change").over(weeks).alias(name), F.lead(WEEK).over(weeks).alias("_until")
    ).where(F.col(name) > 0)
    held = F.sequence(F.col(WEEK), F.date_sub("_until", 7), F.expr("interval 7 days"))
    return counted.select(ENTITY, F.explode(held).alias(WEEK), name)
