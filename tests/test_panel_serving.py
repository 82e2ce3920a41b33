"""The panel on small sources, serving texts, publication and the stream."""

from __future__ import annotations

import datetime

import pytest
from frames import day
from pyspark.sql import functions as F

from tocsin.functions import scoring
from tocsin.operators.onset import localize_onsets
from tocsin.operators.quality import dense_panel_check, duplicate_keys
from tocsin.plans import panel, publish, serving
from tocsin.streaming.ingest import ingest_daily_counts

SNAPSHOT = "2024-06-03 12:00:00"


@pytest.fixture(scope="module")
def gold(spark):
    def frame(name, rows):
        return spark.createDataFrame(rows, panel.SOURCE_LAYOUTS[name])

    sources = panel.PanelSources(
        news_events=frame("news_events", [("UKR", day("2024-01-02"), -4.0, None, 2.0, 1.0), ("UKR", day("2024-01-08"), None, 2.0, None, 3.0)]),
        conflict_events=frame("conflict_events", [
            ("UKR", day("2024-01-01"), "protests", 1.0, "a", "b"), ("UKR", day("2024-01-05"), "riots", None, "a", None),
            ("FRA", day("2024-01-05"), "riots", 2.0, None, None)]),
        violence_events=frame("violence_events", [
            ("UKR", "Ukraine", "Europe", day("2024-01-10"), 3.0, 1, 9, 2024), ("UKR", "Ukraine", "Europe", day("2024-03-01"), 0.0, 2, 8, 2024),
            ("UKR", "Ukraine", "Europe", day("2023-01-09"), 5.0, 1, 9, 2023)]),
        interstate_onsets=frame("interstate_onsets", [("UKR", "Ukraine", 2024, 1, 0, "8")]),
        food=frame("food", [(day("2023-12-01"), 118.44, None), (day("2024-02-01"), 120.0, 99.0)]),
        macro=frame("macro", [("UKR", "Ukraine", 2022, 1.0, 2.0, 3.0)]),
        elections=frame("elections", [("FRA", "France", day("2024-01-28"))]),
    )
    return panel.country_week_features(spark, sources, SNAPSHOT, start="2024-01-01").cache()


def at(gold, iso3, week):
    return gold.where((F.col("country_iso3") == iso3) & (F.col("week_start_date") == day(week))).first()


def test_panel_is_dense_and_complete(gold):
    assert gold.columns == panel.PANEL_COLUMNS and len(gold.columns) == 81
    assert gold.count() == 2 * 23
    assert duplicate_keys(gold, ["country_iso3", "week_start_date"]).isEmpty()
    assert all(r["is_dense"] == 1 for r in dense_panel_check(gold, "country_iso3", "week_start_date").collect())


def test_week_windows_end_on_monday(gold):
    first, second = at(gold, "UKR", "2024-01-01"), at(gold, "UKR", "2024-01-08")
    assert (first["acled_event_count_7d"], second["acled_event_count_7d"], second["acled_event_count_28d"]) == (1, 1, 2)
    assert (second["acled_riot_count_7d"], second["acled_distinct_actor1_count_7d"]) == (1, 1)
    assert (second["gdelt_event_count_7d"], second["gdelt_avg_goldstein_7d"], second["gdelt_avg_event_tone_7d"]) == (2, -2.0, 1.0)
    assert (second["gdelt_num_mentions_7d"], second["gdelt_num_articles_7d"]) == (2.0, 4.0)
    assert at(gold, "FRA", "2024-01-15")["gdelt_avg_goldstein_7d"] is None


def test_history_reaches_365_days_and_quiet_56(gold):
    assert at(gold, "UKR", "2024-01-01")["ucdp_history_best_deaths_52w"] == 5.0
    assert at(gold, "UKR", "2024-01-08")["ucdp_history_event_count_52w"] == 1  # 364 days back is inside
    assert at(gold, "UKR", "2024-01-15")["ucdp_history_best_deaths_52w"] == 3.0
    assert at(gold, "UKR", "2024-01-08")["organized_violence_quiet_56d"] == 1
    assert at(gold, "UKR", "2024-03-04")["organized_violence_quiet_56d"] == 0
    assert at(gold, "UKR", "2024-03-11")["organized_violence_quiet_56d"] == 1


def test_labels_wait_until_they_can_be_known(gold):
    assert at(gold, "UKR", "2024-01-08")["label_escalation_7d"] == 1
    assert at(gold, "UKR", "2024-01-15")["label_escalation_30d"] == 0  # an event without deaths
    assert at(gold, "UKR", "2024-05-27")["label_escalation_7d"] == 0  # ends on the snapshot day
    assert at(gold, "UKR", "2024-06-03")["label_escalation_7d"] is None
    assert at(gold, "UKR", "2024-02-05")["label_onset_30d"] == 1
    assert at(gold, "UKR", "2024-01-08")["label_onset_30d"] == 0  # the named conflict starts in March
    assert at(gold, "UKR", "2024-01-08")["label_interstate_onset_90d"] == 1
    assert at(gold, "UKR", "2024-05-13")["label_onset_30d"] is None
    assert gold.where("not (label_interstate_30d <=> label_interstate_onset_30d)").isEmpty()


def test_asof_and_election_columns(gold):
    row = at(gold, "UKR", "2024-02-05")
    assert (row["food_price_index"], row["food_cereal_price_index"], row["macro_cpi_yoy"]) == (120.0, 99.0, 2.0)
    assert at(gold, "UKR", "2024-01-29")["food_price_index"] == 118.44
    assert (row["days_to_next_election"], row["election_upcoming_90d"]) == (None, 0)
    row = at(gold, "FRA", "2024-01-08")
    assert (row["days_to_next_election"], row["election_upcoming_30d"], row["election_recent_30d"]) == (20, 1, 0)
    assert at(gold, "FRA", "2024-02-05")["days_since_last_election"] == 8


def test_start_is_inferred_from_the_sources(spark):
    sources = panel.PanelSources(
        elections=spark.createDataFrame([("FRA", "France", day("2024-05-15"))], panel.SOURCE_LAYOUTS["elections"])
    )
    weeks = panel.country_week_features(spark, sources, SNAPSHOT).agg(F.min("week_start_date"), F.max("week_start_date")).first()
    assert tuple(weeks) == (day("2024-05-13"), day("2024-06-03"))
    with pytest.raises(ValueError):
        panel.country_week_features(spark, sources, SNAPSHOT, start="2024-02-01", end="2024-01-01")


def test_onset_prefers_the_named_conflict(spark):
    events = spark.createDataFrame(
        [("UKR", day("2024-01-05"), 111), ("UKR", day("2024-01-19"), 999)], "country_iso3 string, event_date_start date, conflict_new_id long"
    )
    onsets = spark.createDataFrame(
        [("UKR", "Ukraine", 2024, 1, 0, "999", "interstate"), ("UKR", "Ukraine", 2024, 1, 0, None, "intrastate"),
         ("FRA", "France", 2024, 1, 0, None, "intrastate"), ("UKR", "Ukraine", 2024, 0, 0, "999", "other")],
        "country_iso3 string, country_name string, year long, onset1 long, onset20 long, conflict_ids string, onset_type string",
    )
    found = {r["onset_type"]: (r["onset_date"], r["localization_method"]) for r in localize_onsets(events, onsets).collect()}
    assert found == {
        "interstate": (day("2024-01-19"), "conflict_id_match"), "intrastate": (day("2024-01-05"), "country_year_fallback"),
    }


@pytest.fixture(scope="module")
def weeks(spark):
    data = []
    for week, known in (("2024-01-01", 0), ("2024-01-08", 1)):
        data.append(("FRA", "France", "Europe", day(week), known, known, known, 1, 1, 12 * known, 119.96, datetime.datetime(2024, 2, 1)))
    data.append(("UKR", "Ukraine", None, day("2024-01-08"), None, 0, 0, 0, 4, 2, None, datetime.datetime(2024, 2, 1)))
    return spark.createDataFrame(
        data,
        "country_iso3 string, country_name string, region_name string, week_start_date date, label_escalation_7d int, "
        "label_escalation_30d int, label_onset_30d int, acled_event_count_7d long, gdelt_event_count_7d long, "
        "acled_event_count_28d long, food_price_index double, snapshot_ts_utc timestamp",
    )


def test_reports_state_the_band(weeks):
    found = {r["country_iso3"]: r for r in serving.report_inputs(weeks).collect()}
    france = found["FRA"]
    assert (france["forecast_probability"], france["risk_level"]) == (0.57, "medium")
    assert france["summary"] == (
        "France is in the medium monitoring band after 12 ACLED events over 28 days, 1 GDELT event over 7 days, "
        "and a food price index of 120.0."
    )
    assert france["chronology"].startswith('["Week of 2024-01-08: 1 ACLED events in the trailing 7 days.", ')
    assert found["UKR"]["risk_level"] is None and found["UKR"]["predicted_conflict_label"] == "Ukraine / Russia"
    assert found["UKR"]["summary"].startswith("Ukraine remains on the current monitoring board because")
    assert len(france["source_snapshot_hash"]) == 64


def test_posts_state_the_movement(weeks):
    found = {r["country_iso3"]: r for r in serving.social_inputs(weeks).collect()}
    france = found["FRA"]
    assert france["headline"] == "France monitoring update: medium"
    assert france["summary_line"].startswith("France moved into the medium monitoring band after 12 ACLED events")
    assert france["score_delta"] == pytest.approx(0.4)
    assert found["UKR"]["score_delta"] is None and found["UKR"]["headline"].endswith("signal watch")
    queue = serving.review_queue(serving.social_inputs(weeks)).collect()
    assert [r["post_id"] for r in queue] == ["post-fra-latest", "post-ukr-latest"]
    assert queue[0]["character_count"] == len(queue[0]["formatted_post"])
    assert queue[0]["formatted_post"].split("\n\n")[2].endswith("brief. /countries/fra-latest")
    with pytest.raises(ValueError, match="headline"):
        serving.review_queue(serving.social_inputs(weeks).drop("headline"))


def test_days_and_horizons(gold):
    days = serving.entity_day_features(gold)
    assert days.count() == gold.count() * 7
    assert days.select("feature_snapshot_hash").distinct().count() == days.count()
    labeled = serving.entity_day_labels(gold)
    assert labeled.count() == gold.count() * 21
    assert labeled.where("horizon_days = 7 and label_onset_30d is not null").isEmpty()
    assert labeled.where("horizon_days = 30 and label_onset_30d is not null").count() > 0


def test_serving_tables_meet_their_contracts(gold):
    from tocsin.plans.contracts import checked

    checked(gold, "country_week_features", unique=True)
    checked(serving.entity_day_features(gold), "entity_day_features", unique=True)
    checked(serving.entity_day_labels(gold), "entity_day_labels", unique=True)
    checked(serving.report_inputs(gold), "report_inputs", unique=True)
    checked(serving.social_inputs(gold), "social_inputs", unique=True)
    with pytest.raises(ValueError, match="missing columns macro_cpi_yoy"):
        checked(gold.drop("macro_cpi_yoy"), "country_week_features")
    with pytest.raises(ValueError, match="not unique"):
        checked(gold.unionByName(gold), "country_week_features", unique=True)


def test_live_signals_keep_the_unknown_country(spark):
    events = spark.createDataFrame(
        [("1", "A", day("2024-01-10"), 1.0, 1.0), ("2", None, day("2024-01-10"), 3.0, 1.0), ("3", "B", day("2024-01-05"), 2.0, 1.0)],
        "global_event_id string, country_id string, event_date date, goldstein_scale double, avg_tone double",
    )
    documents = spark.createDataFrame([("d", "A", day("2024-01-09"), -5.0)], "document_identifier string, document_country_id string, document_date date, tone_score double")
    displaced = spark.createDataFrame([("A", 10.0)], "country_id string, idps double")
    found = {r["country_id"]: r for r in serving.live_signals(events, documents, displaced).collect()}
    assert set(found) == {"A", None, "B"}
    assert found["B"]["current_event_count"] is None and found["B"]["trailing_7d_event_count"] == 1
    assert found["A"]["as_of_date"] == day("2024-01-10")
    assert found["A"]["live_signal_score"] == max(r["live_signal_score"] for r in found.values())


@pytest.fixture(scope="module")
def predictions(spark):
    data = [
        ("FRA", "France", day("2024-01-01"), 0.30, 0.1), ("FRA", "France", day("2024-01-08"), 0.80, 0.1),
        ("UKR", "Ukraine", day("2024-01-08"), 0.80, 0.2), ("IRN", "Iran", day("2024-01-08"), 0.10, 0.9),
    ]
    return spark.createDataFrame(
        data, "country_iso3 string, country_name string, forecast_date date, calibrated_probability double, raw_score double"
    ).withColumns({"model_name": F.lit("m"), "model_version": F.lit("v"), "target_name": F.lit("label_onset_30d"),
                   "horizon_days": F.lit(30).cast("long")})


def test_snapshot_ranks_and_state(spark, predictions):
    snapshot = publish.ranked_snapshot(predictions, F.lit("2024-01-20").cast("timestamp")).cache()
    found = {r["iso3"]: r for r in snapshot.collect()}
    assert [found[c]["rank"] for c in ("UKR", "FRA", "IRN")] == [1, 2, 3]
    assert (found["FRA"]["delta"], found["UKR"]["delta"], found["UKR"]["freshness_tier"]) == (0.5, 0.0, "aging")

    def state(frame, **kwargs):
        settings = {"baseline_used": False, "primary_model": "m", "top_model": "m", "publish_threshold": 0.5, **kwargs}
        return publish.publication_state(frame, "label_onset_30d", **settings).first()

    assert state(snapshot)["alert_type"] == "No Clear Leader" and state(snapshot)["lead_tie_count"] == 2
    clear = snapshot.where("rank <> 2")
    assert state(clear)["alert_type"] == "Onset Watch" and state(clear)["model_status"] == "promoted"
    assert state(clear, top_model="other")["alert_type"] == "Monitoring Only"
    assert state(clear, publish_threshold=0.9)["no_clear_leader"] == 1
    with pytest.raises(ValueError, match="model_name"):
        publish.ranked_snapshot(predictions.drop("model_name"))


def test_lead_conflict_and_detail(spark, predictions):
    snapshot = publish.ranked_snapshot(predictions)
    reports = spark.createDataFrame(
        [("UKR", "ukr-latest", "Ukraine brief", "Clashes with IRAN reported.", '["a", {"feature": "b"}]', None, None, " ", "x", None)],
        "country_iso3 string, report_slug string, report_title string, summary string, chronology string, "
        "top_drivers_json string, predicted_conflict_countries string, predicted_conflict_label string, reason_source string, "
        "source_snapshot_hash string",
    )
    row = publish.predicted_conflict(snapshot, reports, "t", 30).first()
    assert (row["label"], row["reason_source"]) == ("Ukraine / Iran", "report_inputs")
    row = publish.predicted_conflict(snapshot, reports.where("false"), "t", 30).first()
    assert (row["label"], row["reason_source"], row["report_slug"]) == ("Ukraine", "lead_country", None)
    with_drivers = predictions.withColumn("top_positive_drivers", F.lit('[{"feature": "f1", "contribution": 1.0}]'))
    detail = {r["iso3"]: r for r in publish.country_detail(snapshot, with_drivers, reports).collect()}
    assert detail["UKR"]["chronology"] == ["a", "b"] and detail["UKR"]["top_drivers"] == ["f1"]
    assert detail["FRA"]["summary"] is None and detail["FRA"]["alert_band"] == "alert"


def test_driver_labels_of_all_shapes(spark):
    df = spark.createDataFrame([(None,), ("[]",), ('["a", "b"]',), ('[{"feature": "x", "c": 1}, {"c": 2}, "y"]',), ("text",)], "r string")
    found = [r["v"] for r in df.select(scoring.driver_labels("r").alias("v")).collect()]
    assert found == [[], [], ["a", "b"], ["x", "y"], ["text"]]


def test_stream_equals_batch_over_two_runs(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    first = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, 5), 1.0), ("a", datetime.datetime(2024, 1, 2, 5), 2.0)], schema)
    second = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, 9), 4.0), ("b", datetime.datetime(2024, 1, 2, 5), 2.0), ("a", datetime.datetime(2022, 5, 1), 8.0)], schema)
    folder, base = str(tmp_path / "drop"), str(tmp_path / "state")
    first.coalesce(1).write.mode("append").parquet(folder)

    def run():
        found = ingest_daily_counts(spark, folder, first.schema, "k", "ts", base=base, total=F.sum("v"))
        return sorted(tuple(r) for r in found.collect())

    assert run() == [("a", day("2024-01-01"), 1, 1.0), ("a", day("2024-01-02"), 1, 2.0)]
    second.coalesce(1).write.mode("append").parquet(folder)
    assert run() == [("a", day("2022-05-01"), 1, 8.0), ("a", day("2024-01-01"), 2, 5.0), ("a", day("2024-01-02"), 1, 2.0), ("b", day("2024-01-02"), 1, 2.0)]


def test_a_batch_replaces_only_its_days_and_may_be_repeated(spark, tmp_path, monkeypatch):
    from tocsin.streaming import ingest

    schema = "k string, d date, n long"
    home, keys = str(tmp_path / "home"), ["k", "d"]

    def frame(*rows):
        return spark.createDataFrame(rows, schema)

    def table():
        return sorted((tuple(r) for r in ingest.daily_table(spark, f"{home}/table", frame().schema).collect()), key=repr)

    def files(folder="table"):
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "home" / folder).rglob("*.parquet")}

    assert table() == []
    ingest.upsert_days(frame(("a", day("2024-01-01"), 1), ("a", day("2024-01-02"), 1), (None, day("2024-01-02"), 5)), home, 0, keys, "d")
    first = files()
    change = frame(("a", day("2024-01-02"), 2), ("b", day("2024-01-02"), 1), (None, day("2024-01-02"), 6), ("a", day("2024-01-03"), 4))
    ingest.upsert_days(change, home, 1, keys, "d")
    expected = sorted([("a", day("2024-01-01"), 1), ("a", day("2024-01-02"), 2), ("b", day("2024-01-02"), 1),
                       (None, day("2024-01-02"), 6), ("a", day("2024-01-03"), 4)], key=repr)
    assert table() == expected
    untouched = [name for name in first if name in files()]
    assert len(untouched) >= 1 and all(files()[name] == first[name] for name in untouched)
    ingest.upsert_days(change, home, 1, keys, "d")  # done: nothing happens
    assert table() == expected
    size = len(files())
    for batch in range(2, 6):  # the table does not grow with batches, nor do the folders beside it
        ingest.upsert_days(frame(("a", day("2024-01-03"), batch)), home, batch, keys, "d")
    assert len(files()) == size and not files("merged") and not files("changes") and len(files("done")) == 1

    # The run ends between the merged state and the table: the batch comes again and goes on from the merged state.
    real, calls = ingest.daily_table, []

    def broken(*args):
        calls.append(args)
        return real(*args)

    monkeypatch.setattr(ingest, "daily_table", broken)
    merged = frame(("a", day("2024-01-03"), 70))
    merged.write.parquet(f"{home}/merged/6")
    ingest.upsert_days(frame(("z", day("2024-01-01"), 1)), home, 6, keys, "d")
    assert not calls and ("a", day("2024-01-03"), 70) in table() and ("a", day("2024-01-01"), 1) in table()


def test_cells_give_names_start_and_onsets(spark):
    """Rows without a country or a day count for the start or the names only."""
    frame = lambda name, rows: spark.createDataFrame(rows, panel.SOURCE_LAYOUTS[name])
    sources = panel.PanelSources(
        news_events=frame("news_events", [(None, day("2024-03-07"), 1.0, 1.0, 1.0, 1.0), ("UKR", day("2024-05-01"), 1.0, 1.0, 1.0, 1.0)]),
        trade=frame("trade", [("FRA", "France", None, 1.0, 1.0, 1.0, 1.0), ("FRA", " ", day("2024-05-01"), 2.0, None, 1.0, 1.0)]),
    )
    found = panel.country_week_features(spark, sources, SNAPSHOT, actor_sketch=panel.ActorSketch())
    rows = found.orderBy("week_start_date").collect()
    assert {r["country_iso3"] for r in rows} == {"UKR", "FRA"}
    assert rows[0]["week_start_date"] == day("2024-03-04")
    assert {r["country_name"] for r in rows if r["country_iso3"] == "FRA"} == {"France"}
    assert found.columns == [*panel.PANEL_COLUMNS, *[m.name for m in panel.ActorSketch().measures()]]
    assert at(found, "FRA", "2024-05-06")["trade_exports_value_usd"] == 2.0
    assert at(found, "UKR", "2024-05-06")["gdelt_event_count_7d"] == 1


def test_json_texts_are_valid(spark):
    import json

    odd = 'a "b" \\ c\nd\te'
    row = spark.createDataFrame([(odd,)], "v string").select(
        scoring.json_text(("k", F.col("v")), ("n", F.lit(None))).alias("object"),
        scoring.json_array(F.array("v", F.lit("x"))).alias("list"),
        serving.countries_json(F.array(F.struct(F.lit("X").alias("iso3"), F.col("v").alias("country_name")))).alias("countries"),
    ).first()
    assert json.loads(row["object"]) == {"k": odd, "n": None}
    assert json.loads(row["list"]) == [odd, "x"]
    assert json.loads(row["countries"]) == [{"iso3": "X", "country_name": odd}]
