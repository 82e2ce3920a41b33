"""The weekly country panel: features known at each Monday, labels that stay null until they can be known."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tocsin.functions.calendar import days_between, week_start, within_days
from tocsin.functions.scoring import known_flag, short_long_delta
from tocsin.functions.text import blank_to_null, upper_key
from tocsin.operators import grid
from tocsin.operators.grid import RangeSum
from tocsin.operators.onset import localize_onsets, stack_onsets, truth_cutoff
from tocsin.sources.countries import merged_dimension
from tocsin.sources.normalize import SERIES
from tocsin.session import kept
from tocsin.sources.schemas import GOVERNANCE_COMPONENTS, INDICATOR_COLUMNS

# Panel columns in table order.
PANEL_COLUMNS = """
country_iso3 country_name region_name week_start_date
label_escalation_7d label_escalation_30d label_onset_30d label_onset_90d
label_interstate_30d label_interstate_onset_30d label_interstate_onset_90d
organized_violence_quiet_56d
gdelt_event_count_7d gdelt_event_count_28d gdelt_event_count_7d_delta
gdelt_avg_goldstein_7d gdelt_avg_event_tone_7d gdelt_num_mentions_7d gdelt_num_articles_7d
gdelt_document_count_7d gdelt_document_count_28d gdelt_document_count_7d_delta gdelt_avg_document_tone_7d
acled_event_count_7d acled_event_count_7d_delta acled_fatalities_sum_7d acled_fatalities_sum_7d_delta
acled_protest_count_7d acled_protest_count_7d_delta acled_riot_count_7d acled_riot_count_7d_delta
acled_violence_against_civilians_count_7d acled_explosions_remote_violence_count_7d
acled_strategic_developments_count_7d acled_distinct_actor1_count_7d acled_distinct_actor2_count_7d
acled_event_count_28d acled_fatalities_sum_28d
market_oil_price_usd_per_barrel market_gas_price_index market_fertilizer_price_index market_commodity_price_index
food_price_index food_cereal_price_index
trade_exports_value_usd trade_imports_value_usd trade_exports_3m_change_pct trade_imports_3m_change_pct
shipping_lsci_index shipping_port_connectivity_index
governance_voice_and_accountability governance_political_stability governance_government_effectiveness
governance_regulatory_quality governance_rule_of_law governance_control_of_corruption governance_score
days_to_next_election days_since_last_election
election_upcoming_30d election_upcoming_90d election_recent_30d election_recent_90d
climate_drought_severity_index climate_temperature_anomaly_c climate_precipitation_anomaly_pct
climate_night_lights_anomaly_pct climate_night_lights_zscore
security_military_expenditure_usd security_military_expenditure_pct_gdp security_arms_import_volume_index
ucdp_history_event_count_52w ucdp_history_best_deaths_52w ucdp_history_state_based_events_52w
macro_gdp_growth_annual_pct macro_cpi_yoy macro_population_total
humanitarian_refugees humanitarian_asylum_seekers humanitarian_idps
snapshot_ts_utc
""".split()

# Event-type slugs counted one by one, and the panel word for each.
CONFLICT_TYPES = {
    "protests": "protest",
    "riots": "riot",
    "violence_against_civilians": "violence_against_civilians",
    "explosions_remote_violence": "explosions_remote_violence",
    "strategic_developments": "strategic_developments",
}

_MEASURES = {name: ", ".join(f"{measure} double" for measure in spec.measures) for name, spec in SERIES.items()}
_KEY, _NAMED = "country_iso3 string", "country_iso3 string, country_name string"
_ONSET = f"{_NAMED}, year long, onset1 long, onset20 long, conflict_ids string"

# Columns the panel reads from each typed source; a source that is not given counts as empty.
SOURCE_LAYOUTS = {
    "news_events": "country_id string, event_date date, goldstein_scale double, avg_tone double, "
    "num_mentions double, num_articles double",
    "news_documents": "document_country_id string, document_date date, tone_score double",
    "conflict_events": f"{_KEY}, event_date date, event_type_slug string, fatalities double, "
    "actor1_name string, actor2_name string",
    "violence_events": f"{_NAMED}, region_name string, event_date_start date, best_fatalities double, "
    "type_of_violence long, conflict_new_id long, year long",
    "interstate_onsets": _ONSET,
    "intrastate_onsets": _ONSET,
    "market": f"observation_date date, {_MEASURES['market']}",
    "food": f"observation_date date, {_MEASURES['food']}",
    "trade": f"{_NAMED}, observation_date date, {_MEASURES['trade']}",
    "shipping": f"{_NAMED}, observation_date date, {_MEASURES['shipping']}",
    "climate": f"{_NAMED}, observation_date date, {_MEASURES['climate']}",
    "night_lights": f"{_NAMED}, observation_date date, {_MEASURES['night_lights']}",
    "security": f"{_NAMED}, year long, {_MEASURES['security']}",
    "governance": f"{_NAMED}, year long, "
    + ", ".join(f"{name} double" for name in [*GOVERNANCE_COMPONENTS.values(), "governance_score"]),
    "macro": f"{_NAMED}, year long, " + ", ".join(f"{name} double" for name in INDICATOR_COLUMNS.values()),
    "displacement": "country_id string, country_name string, year long, refugees double, "
    "asylum_seekers double, idps double",
    "elections": f"{_NAMED}, election_date date",
}


@dataclass(frozen=True)
class PanelSources:
    """Typed source tables (see ``SOURCE_LAYOUTS``); any may be missing."""

    news_events: DataFrame | None = None
    news_documents: DataFrame | None = None
    conflict_events: DataFrame | None = None
    violence_events: DataFrame | None = None
    interstate_onsets: DataFrame | None = None
    intrastate_onsets: DataFrame | None = None
    market: DataFrame | None = None
    food: DataFrame | None = None
    trade: DataFrame | None = None
    shipping: DataFrame | None = None
    climate: DataFrame | None = None
    night_lights: DataFrame | None = None
    security: DataFrame | None = None
    governance: DataFrame | None = None
    macro: DataFrame | None = None
    displacement: DataFrame | None = None
    elections: DataFrame | None = None

    def filled(self, spark: SparkSession) -> PanelSources:
        """The same sources with empty tables in place of missing ones."""
        return PanelSources(
            **{
                f.name: getattr(self, f.name)
                if getattr(self, f.name) is not None
                else spark.createDataFrame([], SOURCE_LAYOUTS[f.name])
                for f in fields(self)
            }
        )


# --- measures of each source --------------------------------------------------------------------------------

NEWS_EVENT_SUMS = [
    RangeSum("gdelt_event_count_7d", grid.TRAILING_7D),
    RangeSum("gdelt_event_count_28d", grid.TRAILING_28D),
    RangeSum("goldstein_7d", grid.TRAILING_7D, "goldstein_scale"),
    RangeSum("event_tone_7d", grid.TRAILING_7D, "avg_tone"),
    RangeSum("gdelt_num_mentions_7d", grid.TRAILING_7D, "num_mentions"),
    RangeSum("gdelt_num_articles_7d", grid.TRAILING_7D, "num_articles"),
]
NEWS_DOCUMENT_SUMS = [
    RangeSum("gdelt_document_count_7d", grid.TRAILING_7D),
    RangeSum("gdelt_document_count_28d", grid.TRAILING_28D),
    RangeSum("document_tone_7d", grid.TRAILING_7D, "tone_score"),
]
CONFLICT_SUMS = [
    RangeSum("acled_event_count_7d", grid.TRAILING_7D),
    RangeSum("acled_event_count_28d", grid.TRAILING_28D),
    RangeSum("acled_fatalities_sum_7d", grid.TRAILING_7D, "fatalities"),
    RangeSum("acled_fatalities_sum_28d", grid.TRAILING_28D, "fatalities"),
    *[RangeSum(f"acled_{word}_count_7d", grid.TRAILING_7D, f"is_{word}") for word in CONFLICT_TYPES.values()],
    RangeSum("protest_count_28d", grid.TRAILING_28D, "is_protest"),
    RangeSum("riot_count_28d", grid.TRAILING_28D, "is_riot"),
]
VIOLENCE_SUMS = [
    RangeSum("ucdp_history_event_count_52w", grid.HISTORY_52W),
    RangeSum("ucdp_history_best_deaths_52w", grid.HISTORY_52W, "best_fatalities"),
    RangeSum("ucdp_history_state_based_events_52w", grid.HISTORY_52W, "is_state_based"),
    RangeSum("deaths_56d", grid.TRAILING_56D, "best_fatalities"),
    RangeSum("deaths_next_7d", grid.FUTURE_7D, "best_fatalities"),
    RangeSum("deaths_next_30d", grid.FUTURE_30D, "best_fatalities"),
]
ONSET_SUMS = [
    RangeSum("onsets_next_30d", grid.FUTURE_30D),
    RangeSum("onsets_next_90d", grid.FUTURE_90D),
    RangeSum("interstate_onsets_next_30d", grid.FUTURE_30D, "is_interstate"),
    RangeSum("interstate_onsets_next_90d", grid.FUTURE_90D, "is_interstate"),
]


def typed_conflict_rows(events: DataFrame) -> DataFrame:
    """Conflict events with one 0/1 column per counted type."""
    flags = {f"is_{word}": F.coalesce(F.col("event_type_slug") == slug, F.lit(False)).cast("long")
             for slug, word in CONFLICT_TYPES.items()}
    return events.withColumns(flags)


#: Who counts as an actor of a conflict event.
ACTORS = {"actor1": "actor1_name", "actor2": "actor2_name"}


@dataclass(frozen=True)
class ActorSketch:
    """Estimated distinct actors over long ranges, as columns of their own beside the exact ones of 7 days.

    ranges: the suffix of the column and its days. lg_k: see ``grid.RangeDistinct``.
    """

    ranges: dict[str, grid.DayRange] = field(
        default_factory=lambda: {"28d": grid.TRAILING_28D, "52w": grid.HISTORY_52W}
    )
    lg_k: int = 12

    def measures(self) -> list[grid.RangeDistinct]:
        return [
            grid.RangeDistinct(f"acled_distinct_{role}_estimate_{suffix}", days, column, self.lg_k)
            for role, column in ACTORS.items() for suffix, days in self.ranges.items()
        ]


# What every cell of the panel carries beside its own columns.
FIRST_DAY, NAME, REGION, ORDER = "_first_day", "_name", "_region", "_order"


def _also(day: str, name: str | None = None, region: str | None = None) -> dict[str, Column]:
    """First day and first known name and region of a cell."""
    missing = F.lit(None).cast("string")
    return {
        FIRST_DAY: F.min(F.col(day).cast("date")),
        NAME: F.min(blank_to_null(name) if name else missing),
        REGION: F.min(blank_to_null(region) if region else missing),
    }


def conflict_cells(events: DataFrame, prefix: str = "c", sketch: ActorSketch | None = None, **shape) -> DataFrame:
    """Cells of the conflict events. Counts and exact distinct actors are parts of a cell of their own.

    The distinct part reads only keys and actors; sums and sketches share the other pass.
    """
    plain = {**shape.pop("plain", {})}
    if sketch:
        plain |= grid.sketch_columns(sketch.measures(), "event_date", prefix)
    sums = grid.sum_cells(
        typed_conflict_rows(events), "country_iso3", "event_date", CONFLICT_SUMS, prefix, plain=plain, **shape
    )
    actors = grid.distinct_cells(events, "country_iso3", "event_date", ACTORS)
    renamed = actors.withColumnsRenamed({role: prefix + role for role in ACTORS})
    return sums.unionByName(renamed, allowMissingColumns=True)


def violence_cells(events: DataFrame, prefix: str = "v", **shape) -> DataFrame:
    rows = events.withColumn("is_state_based", (F.coalesce("type_of_violence", F.lit(0)) == 1).cast("long"))
    return grid.sum_cells(rows, "country_iso3", "event_date_start", VIOLENCE_SUMS, prefix, **shape)


def onset_cells(onsets: DataFrame, prefix: str = "o") -> DataFrame:
    rows = onsets.withColumn("is_interstate", (F.col("onset_type") == "interstate").cast("long"))
    return grid.sum_cells(rows, "country_iso3", "onset_date", ONSET_SUMS, prefix)


#: Sources that name countries, in the order in which a name is taken; the others know codes only.
NAMING = (
    "macro", "governance", "elections", "climate", "security", "night_lights", "trade", "shipping", "violence_events",
    "displacement",
)
GOVERNANCE_MEASURES = [*GOVERNANCE_COMPONENTS.values(), "governance_score"]
DISPLACED = ["refugees", "asylum_seekers", "idps"]


def source_cells(s: PanelSources, sketch: ActorSketch | None = None) -> DataFrame:
    """Cells of all sources that have countries under one another: one aggregate per source, and one more for actors.

    A cell also holds its first day and a name and region of its country, so the start of the panel, its list of
    countries and the dates of onsets are read from the cells. Violence cells are split by conflict and year for that.
    Rows without a country or day stay in cells of their own, which count for the start or the names only.
    """

    def asof(name: str, day: Column, measures: Sequence[str], entity: str = "country_iso3") -> DataFrame:
        return grid.asof_cells(
            getattr(s, name), entity, day, measures, f"at_{name}", plain=_also("_day", "country_name"), placed=False
        )

    conflicts = F.col("conflict_new_id").cast("long")
    parts = {
        "news_events": grid.sum_cells(
            s.news_events, "country_id", "event_date", NEWS_EVENT_SUMS, "n", plain=_also("event_date"), placed=False
        ),
        "news_documents": grid.sum_cells(
            s.news_documents, "document_country_id", "document_date", NEWS_DOCUMENT_SUMS, "d",
            plain=_also("document_date"), placed=False,
        ),
        "conflict_events": conflict_cells(s.conflict_events, sketch=sketch, plain=_also("event_date"), placed=False),
        "violence_events": violence_cells(
            s.violence_events, by={"_conflict": conflicts, "_year": F.col("year").cast("long")},
            plain=_also("event_date_start", "country_name", "region_name"), placed=False,
        ),
        "elections": grid.date_cells(
            s.elections, "country_iso3", "election_date", "e", plain=_also("_day", "country_name"), placed=False
        ),
        "governance": asof("governance", grid.year_day("year"), GOVERNANCE_MEASURES),
        "macro": asof("macro", grid.year_day("year"), list(INDICATOR_COLUMNS.values())),
        "security": asof("security", grid.year_day("year"), SERIES["security"].measures),
        "displacement": asof("displacement", grid.year_day("year"), DISPLACED, "country_id"),
        **{
            name: asof(name, F.col("observation_date"), SERIES[name].measures)
            for name in ("trade", "shipping", "climate", "night_lights")
        },
    }
    ordered = [
        cells.withColumn(ORDER, F.lit(NAMING.index(name) if name in NAMING else len(NAMING)))
        for name, cells in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)


def cell_dimension(cells: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Countries of the cells with the first known name and region."""
    named = cells.where(F.col(grid.ENTITY).isNotNull()).groupBy(
        upper_key(grid.ENTITY).alias("country_iso3"), F.col(ORDER).alias("source_order")
    ).agg(F.min(NAME).alias("country_name"), F.min(REGION).alias("region_name"))
    return merged_dimension(named, dictionary)


def cell_onsets(cells: DataFrame, onsets: DataFrame) -> DataFrame:
    """Onsets dated by the first days of the violence cells, which are split by conflict and year."""
    days = cells.where((F.col(ORDER) == NAMING.index("violence_events"))).select(
        F.col(grid.ENTITY).alias("country_iso3"), F.col("_year").alias("year"), F.col("_conflict").alias("conflict_new_id"),
        F.col(FIRST_DAY).alias("event_date_start"),
    )
    return localize_onsets(days, onsets)


def country_week_features(
    spark: SparkSession,
    sources: PanelSources,
    snapshot_ts: str,
    start: str | None = None,
    end: str | None = None,
    dictionary: DataFrame | None = None,
    actor_sketch: ActorSketch | None = None,
) -> DataFrame:
    """The full panel: one row per country and week with all features and labels.

    Each source is aggregated to weekly cells, and the cells of all sources are written to the shared folder as one
    table. They are tiny next to the events; everything else starts from them, so that no event is scanned again, and a
    lost executor costs a read of the cells. Cells and the panel skeleton are stacked and read by one window pass per
    country. Values without a country (market, food) are searched on the calendar alone.

    ``actor_sketch`` adds estimated distinct actors of longer ranges behind the fixed columns.
    """
    s = sources.filled(spark)
    if start and end and end < start:
        raise ValueError("The panel must not end before it starts.")
    cells = kept(source_cells(s, actor_sketch), "cells")
    snapshot = F.lit(snapshot_ts).cast("timestamp")
    snapshot_day = snapshot.cast("date")
    current_week = week_start(snapshot_day)
    earliest = cells.agg(week_start(F.min(FIRST_DAY)).alias("start_date")).scalar()
    first_week = week_start(F.lit(start).cast("date")) if start else F.coalesce(earliest, current_week)
    last_week = F.least(week_start(F.lit(end).cast("date")), current_week) if end else current_week

    panel = grid.dense_panel(cell_dimension(cells, dictionary), first_week, last_week).withColumnRenamed(
        "country_iso3", grid.ENTITY
    )
    onset_frames = {"interstate": s.interstate_onsets, "intrastate": s.intrastate_onsets}
    onsets = cell_onsets(cells, stack_onsets(onset_frames))
    onset_known_until = truth_cutoff(list(onset_frames.values()), snapshot_day)
    placed = cells.where(F.col(grid.ENTITY).isNotNull() & F.col(grid.WEEK).isNotNull())
    stacked = grid.stack_cells(
        panel, [placed.drop(FIRST_DAY, NAME, REGION, ORDER, "_conflict", "_year"), onset_cells(onsets)]
    )
    windows: dict[str, Column] = {}
    for prefix, measures in (
        ("n", NEWS_EVENT_SUMS), ("d", NEWS_DOCUMENT_SUMS), ("c", CONFLICT_SUMS), ("v", VIOLENCE_SUMS), ("o", ONSET_SUMS),
    ):
        windows.update({measure.name: grid.range_sum(measure, prefix) for measure in measures})
    for role in ACTORS:
        windows[f"acled_distinct_{role}_count_7d"] = F.coalesce(grid.cell_value("c" + role), F.lit(0))
    estimates = actor_sketch.measures() if actor_sketch else []
    windows.update({measure.name: grid.range_distinct_estimate(measure, "c") for measure in estimates})
    asof_names = (
        "trade", "shipping", "climate", "night_lights", "security", "governance", "macro", "displacement",
    )
    windows.update({f"at_{name}": grid.asof_value(f"at_{name}") for name in asof_names})
    windows.update({"next_election": grid.next_date("e"), "last_election": grid.last_date("e")})
    read = grid.read_panel(stacked, windows, panel.columns)

    bounds = spark.range(1).select(first_week.alias("start_date"), last_week.alias("end_date"))
    calendar = grid.weekly_calendar(bounds)
    shared = grid.asof_global(calendar, s.market, F.col("observation_date"), SERIES["market"].measures)
    shared = grid.asof_global(shared, s.food, F.col("observation_date"), SERIES["food"].measures)
    # One row per week of the panel (a century has 5,218), so this side is small whatever the sources hold.
    joined = read.join(F.broadcast(shared), "week_start_date", "left")
    return joined.select(
        *[column.alias(name) for name, column in _panel_columns(snapshot, snapshot_day, onset_known_until).items()],
        *[measure.name for measure in estimates],
    )


def _panel_columns(snapshot: Column, snapshot_day: Column, onset_known_until: Column) -> dict[str, Column]:
    """Every panel column from the window values, in table order."""
    week = F.col("week_start_date")

    def known_by(days: int, until: Column) -> Column:
        return F.date_add(week, days) <= until

    def mean(total: str, count: str) -> Column:
        return F.when(F.col(count) > 0, F.col(total) / F.col(count))

    to_next, since_last = days_between(week, F.col("next_election")), days_between(F.col("last_election"), week)
    computed = {
        "country_iso3": F.col(grid.ENTITY),
        "label_escalation_7d": known_flag(F.col("deaths_next_7d") > 0, known_by(7, snapshot_day)),
        "label_escalation_30d": known_flag(F.col("deaths_next_30d") > 0, known_by(30, snapshot_day)),
        "label_onset_30d": known_flag(F.col("onsets_next_30d") > 0, known_by(30, onset_known_until)),
        "label_onset_90d": known_flag(F.col("onsets_next_90d") > 0, known_by(90, onset_known_until)),
        "label_interstate_onset_30d": known_flag(
            F.col("interstate_onsets_next_30d") > 0, known_by(30, onset_known_until)
        ),
        "label_interstate_onset_90d": known_flag(
            F.col("interstate_onsets_next_90d") > 0, known_by(90, onset_known_until)
        ),
        "organized_violence_quiet_56d": (F.col("deaths_56d") == 0).cast("long"),
        "gdelt_event_count_7d_delta": short_long_delta("gdelt_event_count_7d", "gdelt_event_count_28d", 4),
        "gdelt_avg_goldstein_7d": mean("goldstein_7d", "gdelt_event_count_7d"),
        "gdelt_avg_event_tone_7d": mean("event_tone_7d", "gdelt_event_count_7d"),
        "gdelt_document_count_7d_delta": short_long_delta("gdelt_document_count_7d", "gdelt_document_count_28d", 4),
        "gdelt_avg_document_tone_7d": mean("document_tone_7d", "gdelt_document_count_7d"),
        "acled_event_count_7d_delta": short_long_delta("acled_event_count_7d", "acled_event_count_28d", 4),
        "acled_fatalities_sum_7d_delta": short_long_delta("acled_fatalities_sum_7d", "acled_fatalities_sum_28d", 4),
        "acled_protest_count_7d_delta": short_long_delta("acled_protest_count_7d", "protest_count_28d", 4),
        "acled_riot_count_7d_delta": short_long_delta("acled_riot_count_7d", "riot_count_28d", 4),
        "days_to_next_election": to_next,
        "days_since_last_election": since_last,
        "election_upcoming_30d": within_days(to_next, 30),
        "election_upcoming_90d": within_days(to_next, 90),
        "election_recent_30d": within_days(since_last, 30),
        "election_recent_90d": within_days(since_last, 90),
        "humanitarian_refugees": F.col("at_displacement.refugees"),
        "humanitarian_asylum_seekers": F.col("at_displacement.asylum_seekers"),
        "humanitarian_idps": F.col("at_displacement.idps"),
        "snapshot_ts_utc": snapshot,
    }
    computed["label_interstate_30d"] = computed["label_interstate_onset_30d"]
    for name in ("trade", "shipping", "climate", "night_lights", "security"):
        computed.update({measure: F.col(f"at_{name}.{measure}") for measure in SERIES[name].measures})
    for measure in [*GOVERNANCE_COMPONENTS.values(), "governance_score"]:
        computed[measure] = F.col(f"at_governance.{measure}")
    for measure in INDICATOR_COLUMNS.values():
        computed[measure] = F.col(f"at_macro.{measure}")
    return {name: computed.get(name, F.col(name)) for name in PANEL_COLUMNS}


# --- calendar-week summaries --------------------------------------------------------------------------------


def weekly_news_summary(events: DataFrame) -> DataFrame:
    """News events per country and calendar week: count, null-skipping means, sums."""
    known = events.where(F.col("country_id").isNotNull() & F.col("event_date").isNotNull())
    return known.groupBy(F.col("country_id").alias("country_iso3"), week_start("event_date").alias("week_start_date")).agg(
        F.count("global_event_id").alias("gdelt_event_count_7d"),
        F.avg("goldstein_scale").alias("gdelt_avg_goldstein_7d"),
        F.avg("avg_tone").alias("gdelt_avg_event_tone_7d"),
        F.coalesce(F.sum("num_mentions"), F.lit(0.0)).alias("gdelt_num_mentions_7d"),
        F.coalesce(F.sum("num_articles"), F.lit(0.0)).alias("gdelt_num_articles_7d"),
    )


def weekly_document_summary(documents: DataFrame) -> DataFrame:
    """Documents per country and calendar week: count and null-skipping mean tone."""
    known = documents.where(F.col("document_country_id").isNotNull() & F.col("document_date").isNotNull())
    return known.groupBy(
        F.col("document_country_id").alias("country_iso3"), week_start("document_date").alias("week_start_date")
    ).agg(
        F.count("document_identifier").alias("gdelt_document_count_7d"),
        F.avg("tone_score").alias("gdelt_avg_document_tone_7d"),
    )


def weekly_conflict_summary(events: DataFrame) -> DataFrame:
    """Conflict events per country and calendar week: counts by type, deaths, distinct actors."""
    known = typed_conflict_rows(events.where(F.col("country_iso3").isNotNull() & F.col("event_date").isNotNull()))
    sums = known.groupBy("country_iso3", week_start("event_date").alias("week_start_date")).agg(
        F.count("source_record_id").alias("acled_event_count_7d"),
        F.sum(F.coalesce("fatalities", F.lit(0.0))).alias("acled_fatalities_sum_7d"),
        *[F.sum(f"is_{word}").alias(f"acled_{word}_count_7d") for word in CONFLICT_TYPES.values()],
    )
    actors = grid.distinct_cells(events, "country_iso3", "event_date", ACTORS, week=week_start).select(
        F.col(grid.ENTITY).alias("country_iso3"), grid.WEEK, *ACTORS
    )
    both = sums.join(actors, ["country_iso3", "week_start_date"], "left")
    counts = {f"acled_distinct_{role}_count_7d": F.coalesce(role, F.lit(0)) for role in ACTORS}
    return both.select(*sums.columns, *[count.alias(name) for name, count in counts.items()])
