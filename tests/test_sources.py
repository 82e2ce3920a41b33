"""File scans, normalizers and text functions on small files."""

from __future__ import annotations

import json

import pytest
from frames import day
from pyspark.sql import functions as F

from tocsin.functions import text
from tocsin.functions.calendar import closing_monday, week_start
from tocsin.operators.quality import profile_tables, require_columns
from tocsin.sources import countries, normalize, readers, schemas, sinks

NOW = "2024-05-01 00:00:00"


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(
        [
            ("FRA", "FR", "France", None), ("UKR", "UA", "Ukraine", None), ("RUS", "RU", "Russian Federation", None),
            ("IRN", "IR", "Iran, Islamic Republic of", "Iran"), ("XKX", "XK", "Kosovo", None),
        ],
        "iso3 string, iso2 string, name string, common_name string",
    )


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_weeks_start_on_monday(spark):
    found = spark.createDataFrame([(day("2024-01-01"),), (day("2024-01-07"),)], "d date").select(
        week_start("d").alias("a"), closing_monday("d").alias("b")
    ).collect()
    assert [tuple(r) for r in found] == [
        (day("2024-01-01"), day("2024-01-01")), (day("2024-01-01"), day("2024-01-08")),
    ]


@pytest.mark.parametrize(
    "call, expected",
    [
        (lambda: text.slug(F.lit("  Violence / against--civilians! ")), "violence_against_civilians"),
        (lambda: text.slug(F.lit(" !! ")), None),
        (lambda: text.last_segment(F.lit("Kyiv, , Ukraine , ")), "Ukraine"),
        (lambda: text.last_segment(F.lit(" , ")), None),
        (lambda: text.first_present(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")), " x "),
        (lambda: text.to_number(F.lit("NaN")), None),
        (lambda: text.to_number(F.lit(" 4.5 ")), 4.5),
        (lambda: text.to_number(F.lit("four")), None),
        (lambda: text.leading_number(F.lit("-3.5,1,2")), -3.5),
        (lambda: text.ints_in_text(F.lit("12, 7;12 x")), [12, 7]),
        (lambda: text.ints_in_text(F.lit(None).cast("string")), []),
        (lambda: text.distinct_in_order(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b"))), ["b", "a"]),
        (lambda: text.row_mean(F.lit(1.0), F.lit(None).cast("double"), F.lit(4.0)), 2.5),
        (lambda: countries.lookup_key(F.lit(" Russia ")), "russian federation"),
        (lambda: countries.lookup_key(F.lit("Kosovo")), None),
    ],
)
def test_text_functions(spark, call, expected):
    assert one(spark, call()) == expected


def test_names_resolve_by_any_spelling(spark, dictionary):
    names = ["france", " UA ", "rus", "Russia", "Iran", "Kosovo", "Atlantis", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    found = [r["country_iso3"] for r in countries.resolve_country(df, "n", dictionary).orderBy("i").collect()]
    assert found == ["FRA", "UKR", "RUS", "RUS", "IRN", None, None, None]


def test_conflict_csv(spark, dictionary, tmp_path):
    lines = [",".join(schemas.CONFLICT_EVENT_COLUMNS)]
    lines.append('1,,9,2024-02-03,Protests,Peaceful protest," Youth, group ",,,,Ukraine,A,,Kyiv,50.4,30.5,2,"said ""no""",src,2024-02-04 01:00:00')
    lines.append("2,UKR2,9,not a date,Riots,,x,,,,Ukraine,A,,Kyiv,50.4,30.5,2,n,src,")
    lines.append("3,FRA3,9,2024-02-05,Riots,,x,,,,Nowhere,A,,Kyiv,50.4,30.5,2,n,src,")
    (tmp_path / "c.csv").write_text("\n".join(lines))
    raw = readers.read_conflict_events(spark, str(tmp_path / "c.csv"))
    found = normalize.conflict_events(raw, dictionary, NOW).collect()
    assert len(found) == 1
    row = found[0]
    assert (row["source_record_id"], row["country_iso3"], row["event_date"]) == ("1", "UKR", day("2024-02-03"))
    assert (row["sub_event_type_slug"], row["actor1_name"], row["actor2_name"]) == ("peaceful_protest", "Youth, group", None)
    assert (row["fatalities"], row["notes"]) == (2.0, 'said "no"')


def test_news_files(spark, dictionary, tmp_path):
    event = {name: "" for name in schemas.NEWS_EVENT_COLUMNS}
    event.update(global_event_id="7", sql_date="20240203", date_added="20240203101500", action_geo_full_name="Paris, France",
                 goldstein_scale="-2.5", num_mentions="3", avg_tone="x")
    (tmp_path / "e.tsv").write_text("\t".join(event[c] for c in schemas.NEWS_EVENT_COLUMNS) + "\n")
    row = normalize.news_events(readers.read_news_events(spark, str(tmp_path / "e.tsv")), dictionary).first()
    assert (row["country_id"], row["event_date"], row["goldstein_scale"], row["avg_tone"]) == ("FRA", day("2024-02-03"), -2.5, None)

    document = {name: "" for name in schemas.NEWS_DOCUMENT_COLUMNS}
    document.update(gkg_record_id="g", date="20240203101500", document_identifier="u", v2_tone="1.5,2",
                    v2_locations='1#France#FR#FR#0;4#"Kyiv", Kyiv, Ukraine#UP#UP1#;4#Lyon, France#FR#FR2#;1#x')
    (tmp_path / "d.tsv").write_text("\t".join(document[c] for c in schemas.NEWS_DOCUMENT_COLUMNS) + "\n")
    found = normalize.news_documents(readers.read_news_documents(spark, str(tmp_path / "d.tsv")), dictionary).collect()
    assert [(r["document_country_id"], r["tone_score"]) for r in found] == [("FRA", 1.5), ("UKR", 1.5)]


def test_whole_name_places_fall_back_to_their_last_part(spark, dictionary):
    document = {name: None for name in schemas.NEWS_DOCUMENT_COLUMNS}
    document.update(gkg_record_id="g", date="x", v2_tone="", v2_locations="1#Lyon, France#FR#FR#0")
    raw = spark.createDataFrame([tuple(document.values())], schemas.NEWS_DOCUMENTS)
    row = normalize.news_documents(raw, dictionary).first()
    assert (row["document_country_id"], row["document_date"], row["tone_score"]) == ("FRA", None, None)


def test_quoted_violence_csv(spark, dictionary, tmp_path):
    columns = ["id", "year", "type_of_violence", "conflict_new_id", "conflict_dset_id", "conflict_name", "side_a", "side_b",
               "source_date", "where_prec", "adm_1", "adm_2", "latitude", "longitude", "country", "region", "date_start",
               "date_end", "best", "high", "low"]
    row = ['5', '2024', '1', '77', 'd', '"two\nlines"', 'a', 'b', '"2024-01-02;2024-01-03"', '1', '', '', '1', '2', 'Ukraine',
           'Europe', '2024-01-01', '2024-01-02', '4', '5', '3']
    (tmp_path / "v.csv").write_text(",".join(columns) + "\n" + ",".join(row) + "\n")
    raw = readers.read_quoted_csv(spark, str(tmp_path / "v.csv"), columns)
    found = normalize.violence_events(normalize.min_year(raw, 2020), dictionary, NOW).first()
    assert (found["event_type"], found["conflict_new_id"], found["best_fatalities"]) == ("state_based", 77, 4.0)
    assert found["conflict_name"] == "two\nlines" and found["publication_ts_utc"].date() == day("2024-01-02")
    assert normalize.min_year(raw, 2025).count() == 0


def test_json_files(spark, tmp_path):
    items = {"page": 1, "items": [
        {"year": 2020, "coo_iso": "UKR", "coo_name": "Ukraine", "refugees": "12", "idps": "-"},
        {"year": 2020, "coo_iso": "-", "coo_name": "Unknown", "refugees": 1}]}
    (tmp_path / "i.json").write_text(json.dumps(items, indent=1))
    found = normalize.displacement(readers.read_json_items(spark, str(tmp_path / "i.json"))).collect()
    assert [(r["country_id"], r["year"], r["refugees"], r["idps"]) for r in found] == [("UKR", 2020, 12.0, 0.0)]

    row = {"indicator": {"id": "FP.CPI.TOTL.ZG", "value": "Inflation"}, "country": {"id": "UA", "value": "Ukraine"},
           "countryiso3code": "UKR", "date": "2021", "value": 9.4}
    pair = [{"page": 1, "lastupdated": "2024-03-01"}, [row, {**row, "countryiso3code": ""}, {**row, "date": "2022", "value": None}]]
    (tmp_path / "p.json").write_text(json.dumps(pair))
    rows = normalize.indicators(readers.read_json_pair(spark, str(tmp_path / "p.json")), NOW)
    assert rows.count() == 2
    wide = normalize.pivot_indicators(rows).collect()
    assert [(r["year"], r["macro_cpi_yoy"], r["macro_population_total"]) for r in wide] == [(2021, 9.4, None)]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="metadata and rows"):
        readers.read_json_pair(spark, str(tmp_path / "bad.json")).collect()


def test_series_governance_elections_onsets(spark, dictionary):
    raw = spark.createDataFrame(
        [("ukr ", "Ukraine", "2024-01-01", "1.5", "x"), (None, "?", "2024-01-01", "1", "1"), ("FRA", "France", "no", "1", "1")],
        "country_iso3 string, country_name string, observation_date string, shipping_lsci_index string, "
        "shipping_port_connectivity_index string",
    )
    row = normalize.series(raw, normalize.SERIES["shipping"], NOW).collect()
    assert len(row) == 1 and row[0]["source_record_id"] == "UKR-2024-01-01" and row[0]["shipping_port_connectivity_index"] is None
    assert row[0]["publication_ts_utc"].date() == day("2024-01-01")

    raw = spark.createDataFrame(
        [("UKR", "Ukraine", "2020", "1", "2", None, "x", "", "6")],
        "country_iso3 string, country_name string, year string, " + ", ".join(f"{c} string" for c in schemas.GOVERNANCE_COMPONENTS),
    )
    assert normalize.governance(raw, NOW).first()["governance_score"] == pytest.approx(3.0)

    raw = spark.createDataFrame([("UKR", "Ukraine", "2024-03-31", "Local / City")], "country_iso3 string, country_name string, election_date string, election_type string")
    assert normalize.elections(raw, NOW).first()["source_record_id"] == "UKR-2024-03-31-local_city"

    raw = spark.createDataFrame(
        [("Ukraine", "2022", "1", "1", None, None, None, None, "1", " 12; 13 ", None)],
        ", ".join(f"{c} string" for c in schemas.ONSET_COLUMNS),
    )
    row = normalize.onsets(raw, dictionary, "interstate", NOW).first()
    assert (row["onset1"], row["onset2"], row["conflict_ids"], row["year_prev"]) == (1, 0, "12; 13", None)


def test_layer_and_record_sinks(spark, tmp_path):
    df = spark.createDataFrame([("UKR", day("2023-05-01"), 1), ("FRA", day("2024-05-01"), 2)], "country_iso3 string, d date, x int")
    path = sinks.write_layer(df, str(tmp_path), "silver", "conflict", "events", date_column="d", sort_by=["country_iso3"])
    assert path.endswith("/silver/conflict/events")
    back = readers.read_table(spark, path)
    assert back.where("part_year = 2024").count() == 1 and back.count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "x.csv"))
    sinks.write_records(df, str(tmp_path / "records"), partition_by="country_iso3")
    assert (tmp_path / "records" / "record_key=ukr").exists()


def test_fallback_prefers_the_usable_table(spark):
    good = spark.createDataFrame([("A", day("2024-01-01"), 0.5)], "k string, forecast_date date, calibrated_probability double")
    bad = spark.createDataFrame([("A", day("2024-01-01"), float("nan"))], good.schema)
    required = ["k", "forecast_date", "calibrated_probability"]
    assert readers.read_with_fallback(good, bad, required).first()["baseline_used"] is False
    assert readers.read_with_fallback(bad, good, required).first()["baseline_used"] is True
    assert readers.read_with_fallback(good.drop("k"), good, required).first()["baseline_used"] is True
    with pytest.raises(ValueError, match="invalid"):
        readers.read_with_fallback(bad, None, required)


def test_contract_and_profile(spark):
    df = spark.createDataFrame([("A", None), (None, 1)], "k string, v int")
    with pytest.raises(ValueError, match="missing columns w"):
        require_columns(df, ["k", "w"], "table")
    row = profile_tables({"t": (df, ["k", "v", "z"])}).first()
    assert tuple(row) == ("t", 2, 2, "k=1;v=1")


def test_csv_columns_by_name(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text(f'c,a,x\n{k},"one ""{k}""",9\n')
    read = readers.read_csv(spark, str(tmp_path), ["a", "b", "c"], optional=["b"])
    assert sorted(tuple(r) for r in read.collect()) == [('one "0"', None, "0"), ('one "1"', None, "1")]
    with pytest.raises(ValueError, match="b"):
        readers.read_csv(spark, str(tmp_path), ["a", "b", "c"])
    (tmp_path / "2.csv").write_text("a,c,x\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.read_csv(spark, str(tmp_path), ["a", "c"]).collect()


def test_profiles_are_counted_by_the_write(spark, tmp_path):
    """One job reads the source, however the table is laid out, and the counts are those of a profile by a scan."""
    from tocsin.operators.quality import Profile, profile_report, table_profile
    from tocsin.sources.sinks import write_layer

    source = spark.range(1000).select(
        F.col("id"), F.date_add(F.lit("2023-06-01").cast("date"), (F.col("id") % 400).cast("int")).alias("d"),
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"),
    )
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = source.mapInArrow(seen, source.schema)
    plain, layered = Profile("plain", ["k", "absent"]), Profile("layered", ["d", "k"])
    path = write_layer(counted, str(tmp_path), "silver", "x", "plain", profile=plain)
    assert read.value == 1000
    other = write_layer(source, str(tmp_path), "silver", "x", "layered", date_column="d", sort_by=["k"], profile=layered)
    found = profile_report(spark, [plain, layered]).collect()
    expected = [table_profile(spark.read.parquet(path), "plain", ["k", "absent"]).first(),
                table_profile(spark.read.parquet(other), "layered", ["d", "k"]).first()]
    assert [tuple(r) for r in found] == [tuple(r) for r in expected]
    assert found[0]["null_counts"] == "k=143"
