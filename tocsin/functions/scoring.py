"""Flags, bands, template texts and digests used by labels, serving tables and publication."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights, caps and band limits of the monitoring score.
ESCALATION_30D_WEIGHT = 0.1
ESCALATION_7D_WEIGHT = 0.1
ONSET_30D_WEIGHT = 0.05
CONFLICT_CAP, CONFLICT_DIVISOR = 10, 50.0
NEWS_CAP, NEWS_DIVISOR = 20, 200.0
FOOD_CAP, FOOD_DIVISOR = 200.0, 1000.0
HIGH_RISK, MEDIUM_RISK = 0.6, 0.3
CLEAR_LEAD_MARGIN = 0.02


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _int0(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long"))


def _num0(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def known_flag(condition: Column, known: Column) -> Column:
    """0/1 once the outcome can be known, null before."""
    return F.when(known, F.coalesce(condition, F.lit(False)).cast("long"))


def short_long_delta(short: Column | str, long: Column | str, periods: int) -> Column:
    """Short-window total minus the per-period share of the long-window total."""
    short, long = _c(short).cast("double"), _c(long).cast("double")
    return short if periods <= 0 else short - long / F.lit(float(periods))


def clip01(probability: Column | str) -> Column:
    """Probability clamped to [0, 1]."""
    return F.greatest(F.least(_c(probability).cast("double"), F.lit(1.0)), F.lit(0.0))


def targets_known() -> Column:
    """All three labels behind the monitoring score are known."""
    return (
        F.col("label_escalation_7d").isNotNull()
        & F.col("label_escalation_30d").isNotNull()
        & F.col("label_onset_30d").isNotNull()
    )


def risk_score() -> Column:
    """Capped weighted sum of labels, event counts and the food index; null while a label is unknown."""
    parts = [
        _int0("label_escalation_30d") * F.lit(ESCALATION_30D_WEIGHT),
        _int0("label_escalation_7d") * F.lit(ESCALATION_7D_WEIGHT),
        _int0("label_onset_30d") * F.lit(ONSET_30D_WEIGHT),
        F.least(_int0("acled_event_count_28d"), F.lit(CONFLICT_CAP)) / F.lit(CONFLICT_DIVISOR),
        F.least(_int0("gdelt_event_count_7d"), F.lit(NEWS_CAP)) / F.lit(NEWS_DIVISOR),
        F.least(_num0("food_price_index"), F.lit(FOOD_CAP)) / F.lit(FOOD_DIVISOR),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.when(targets_known(), F.bround(F.least(total, F.lit(1.0)), 2))


def risk_level(score: Column | str) -> Column:
    """Band of a monitoring score; null for an unknown score."""
    score = _c(score)
    return F.when(score >= HIGH_RISK, "high").when(score >= MEDIUM_RISK, "medium").when(score.isNotNull(), "low")


def plural_phrase(count: Column, noun: str) -> Column:
    """``1 event`` or ``2 events``."""
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))


def _one_decimal(column: str) -> Column:
    return F.bround(_num0(column), 1).cast("string")


def driver_texts() -> Column:
    """Three driver lines of a panel row."""
    return F.array(
        F.concat(F.lit("ACLED events (28d): "), _int0("acled_event_count_28d").cast("string")),
        F.concat(F.lit("GDELT events (7d): "), _int0("gdelt_event_count_7d").cast("string")),
        F.concat(F.lit("Food price index: "), _one_decimal("food_price_index")),
    )


def chronology_texts() -> Column:
    """Three chronology lines of a panel row."""
    return F.array(
        F.concat(
            F.lit("Week of "), F.date_format("week_start_date", "yyyy-MM-dd"), F.lit(": "),
            _int0("acled_event_count_7d").cast("string"), F.lit(" ACLED events in the trailing 7 days."),
        ),
        F.concat(F.lit("Trailing 28-day ACLED events: "), _int0("acled_event_count_28d").cast("string"), F.lit(".")),
        F.concat(
            F.lit("GDELT event count in the trailing 7 days: "),
            _int0("gdelt_event_count_7d").cast("string"), F.lit("."),
        ),
    )


def conflict_phrase() -> Column:
    return plural_phrase(_int0("acled_event_count_28d"), "ACLED event")


def news_phrase() -> Column:
    return plural_phrase(_int0("gdelt_event_count_7d"), "GDELT event")


def summary_text(level: Column | str) -> Column:
    """One-sentence brief of a panel row, with and without a band."""
    level, food = _c(level), _one_decimal("food_price_index")
    unknown = F.concat(
        F.col("country_name"),
        F.lit(" remains on the current monitoring board because the latest weekly signals show "),
        conflict_phrase(), F.lit(" over 28 days, "), news_phrase(),
        F.lit(" over 7 days, and a food price index of "), food, F.lit("."),
    )
    known = F.concat(
        F.col("country_name"), F.lit(" is in the "), level, F.lit(" monitoring band after "),
        conflict_phrase(), F.lit(" over 28 days, "), news_phrase(),
        F.lit(" over 7 days, and a food price index of "), food, F.lit("."),
    )
    return F.when(level.isNull(), unknown).otherwise(known)


def json_quoted(text: Column) -> Column:
    """A string as JSON text: quotes, backslashes and line breaks escaped."""
    out = F.regexp_replace(text, r'(["\\\\])', r"\\$1")
    for sign, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_text(*fields: tuple[str, Column]) -> Column:
    """Flat JSON object text, keys in the given order, ``", "`` and ``": "`` as separators."""
    parts: list[Column] = []
    for position, (name, value) in enumerate(fields):
        opening = "{" if position == 0 else ", "
        text = F.coalesce(json_quoted(value.cast("string")), F.lit("null"))
        parts += [F.lit(f'{opening}"{name}": '), text]
    return F.concat(*parts, F.lit("}"))


def json_array(items: Column) -> Column:
    """JSON array text of strings with ``", "`` between items."""
    quoted = F.transform(items, json_quoted)
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def snapshot_text(ts: Column | str) -> Column:
    """Timestamp text as used inside digests."""
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def snapshot_hash() -> Column:
    """Digest of the identity of a panel row."""
    week = F.date_format("week_start_date", "yyyy-MM-dd HH:mm:ss")
    return F.sha2(
        json_text(
            ("country_iso3", F.col("country_iso3")),
            ("snapshot_ts_utc", snapshot_text("snapshot_ts_utc")),
            ("week_start_date", week),
        ),
        256,
    )


def feature_hash(columns: list[str]) -> Column:
    """Digest of a feature row: sorted keys, shortest decimal text of each number."""
    parts: list[Column] = []
    for position, name in enumerate(sorted(columns)):
        opening = "{" if position == 0 else ", "
        parts += [F.lit(f'{opening}"{name}": '), F.coalesce(F.col(name).cast("string"), F.lit("null"))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def freshness_by_hours(
    reference: Column, snapshot: Column, fresh_days: int = 10, stale_days: int = 21
) -> Column:
    """Tier by fractional age in days: fresh, aging, stale."""
    seconds = F.unix_timestamp(reference) - F.unix_timestamp(snapshot)
    age = F.greatest(seconds / F.lit(86400.0), F.lit(0.0))
    return F.when(age <= fresh_days, "fresh").when(age <= stale_days, "aging").otherwise("stale")


def freshness_by_days(
    reference: Column, as_of: Column, fresh_days: int = 10, stale_days: int = 21, critical_days: int = 60
) -> Column:
    """Tier by whole days: fresh, aging, stale, critical."""
    age = F.greatest(F.datediff(reference, as_of), F.lit(0))
    return (
        F.when(age <= fresh_days, "fresh")
        .when(age <= stale_days, "aging")
        .when(age <= critical_days, "stale")
        .otherwise("critical")
    )


def target_family(name: Column | str) -> Column:
    """onset, escalation, or the lowered name itself."""
    lowered = F.lower(F.trim(_c(name)))
    return (
        F.when(lowered.contains("onset"), "onset").when(lowered.contains("escalation"), "escalation").otherwise(lowered)
    )


def driver_labels(raw: Column | str) -> Column:
    """JSON list of strings or of ``{feature}`` objects to an array of names; other text is kept as one item."""
    raw = _c(raw).cast("string")
    options = {"mode": "PERMISSIVE"}
    items = F.when(F.substring(F.trim(raw), 1, 1) == "[", F.from_json(raw, "array<string>", options))
    named = F.transform(
        items,
        lambda item: F.when(F.substring(F.ltrim(item), 1, 1) == "{", F.get_json_object(item, "$.feature")).otherwise(
            item
        ),
    )
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(items.isNotNull(), F.array_compact(named))
        .otherwise(F.array(raw))
    )


def alert_band(
    probability: Column | str, alert: float = 0.7, operating: float = 0.6, warning: float = 0.5
) -> Column:
    """Operational band of a probability under three thresholds."""
    probability = _c(probability)
    return (
        F.when(probability >= alert, "alert")
        .when(probability >= operating, "operating")
        .when(probability >= warning, "warning")
        .otherwise("below_threshold")
    )
