import datetime as D
import json
from zoneinfo import ZoneInfo

from faultline.operators.instants import abbreviations, read_instants

SOURCES = [("berlin-desk", "Europe/Berlin", "dmy"), ("ny", "America/New_York", "mdy"), ("tokyo", "Asia/Tokyo", "ymd")]


def _read(spark, values, source="berlin-desk", sources=SOURCES, **kw):
    rows = spark.createDataFrame([(i, source, v) for i, v in enumerate(values)], "record_id long, source string, raw string")
    s = spark.createDataFrame(sources, "source string, time_zone string, day_month_order string")
    return [r.start_us for r in read_instants(rows, "raw", s, "source", **kw).orderBy("record_id").collect()]


def us(*a, zone="UTC", micro=0):
    return int(D.datetime(*a, tzinfo=ZoneInfo(zone)).timestamp()) * 10**6 + micro


def test_forms(spark):
    noon = us(2026, 3, 4, 12, 0, 5)
    same = ["2026-03-04T12:00:05Z", "2026-03-04t12:00:05z", " \t2026-03-04 13:00:05\n", "2026-03-04T13:00:05+01:00[Europe/Berlin]", "2026-03-04 13:00:05+01", "2026-03-04 13:00:05+0100", "04.03.2026 13:00:05", "04/03/2026 13:00:05", "Wed, 04 Mar 2026 12:00:05 GMT", "20260304T120005Z", "04-Mar-2026 13:00:05 +0100", "2026/03/04 13:00:05", "2026-03-04 13:00:05 CET", "2026-03-04 12:00:05 UTC", "1772625605"]
    assert _read(spark, same) == [noon] * len(same)
    assert _read(spark, ["2026-03-04T12:00:05.123456789Z", "2026-03-04T12:00:05,12Z", "1772625605123", "1772625605123456", "1772625605123456789", "1772625605.1234567"]) == [noon + 123456, noon + 120000, noon + 123000, noon + 123456, noon + 123456, noon + 123456]
    assert _read(spark, ["03/04/2026 7:00:05 AM", "03/04/2026 7:00:05 PM", "03/04/2026 12:00:05 AM"], "NY") == [noon, noon + 12 * 3600 * 10**6, us(2026, 3, 4, 5, 0, 5)]


def test_unreadable_and_null(spark):
    assert _read(spark, [None, "", "-", "n/a", "unknown", "2026-13-40 10:00:00", "2026-02-30T00:00:00Z", "2026-03-04 25:00:00", "2026-03-04 13:00:05 XYZ"]) == [None] * 9


def test_clock_changes(spark):
    # repeated hour: the earlier instant; skipped hour: the offset before the change
    assert _read(spark, ["2025-10-26 02:30:00", "2026-03-29 02:30:00", "2025-10-26 02:30:00 CET", "2025-10-26 02:30:00 CEST"]) == [us(2025, 10, 26, 0, 30), us(2026, 3, 29, 1, 30), us(2025, 10, 26, 1, 30), us(2025, 10, 26, 0, 30)]


def test_source_spellings_and_unknown_source(spark):
    assert _read(spark, ["2026-03-04 21:00:05"], " TOKYO ") == [us(2026, 3, 4, 12, 0, 5)]
    assert _read(spark, ["2026-03-04 12:00:05"], "elsewhere") == [us(2026, 3, 4, 12, 0, 5)]


def test_undeclared_zone_is_estimated(spark):
    rows, n = [], 0
    for i in range(30):
        t = us(2026, 1, 1 + i % 28, 6, i)
        local = D.datetime.fromtimestamp(t / 1e6, ZoneInfo("Asia/Tokyo"))
        for raw in (local.strftime("%Y-%m-%d %H:%M:%S"), D.datetime.fromtimestamp(t / 1e6 + 5, D.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")):
            rows.append((n, "blind", raw, D.datetime.fromtimestamp(t / 1e6 + 60, D.timezone.utc), t))
            n += 1
    df = spark.createDataFrame([(r[0] // 2, *r[1:]) for r in rows], "record_id long, source string, raw string, received_at timestamp, truth long")
    s = spark.createDataFrame([*SOURCES, ("blind", None, "ymd")], "source string, time_zone string, day_month_order string")
    got = read_instants(df, "raw", s, "source", "received_at", "record_id").collect()
    assert all(abs(r.start_us - r.truth) <= 5_000_000 for r in got)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ny", "x", 5)], "record_id long, source string, raw string, time_zone int")
    s = spark.createDataFrame(SOURCES, "source string, time_zone string, day_month_order string")
    assert read_instants(df.limit(0), "raw", s, "source").count() == 0
    assert read_instants(df, "raw", s, "source").first().start_us is None
    assert abbreviations(["America/New_York"])["America/New_York|EDT"] == -4 * 3600


def test_zone_of_an_absent_source_is_estimated_in_p2_found(spark, tmp_path):
    from faultline.operators.queries import p2_found

    rows, truth = [], {}
    for i in range(24):
        t = us(2026, 1 + i % 12, 5, 6, i)
        spans = [{"span_id": f"a{i}", "start_time": D.datetime.fromtimestamp(t / 1e6, ZoneInfo("Asia/Kolkata")).strftime("%Y-%m-%d %H:%M:%S")}, {"span_id": f"b{i}", "start_time": D.datetime.fromtimestamp(t / 1e6 + 5, D.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}]
        rows.append((i, "raw_upload", "blind", D.datetime.fromtimestamp(t / 1e6 + 60, D.timezone.utc), json.dumps({"spans": spans})))
        truth[f"a{i}"] = t
    spark.createDataFrame(rows, "record_id long, layout string, source string, received_at timestamp, body string").write.parquet(str(tmp_path / "raw_records.parquet"))
    spark.createDataFrame(SOURCES, "source string, time_zone string, day_month_order string").write.parquet(str(tmp_path / "upload_sources.parquet"))
    got = {r.span_id: r.start_us for r in p2_found(spark, str(tmp_path)).collect()}
    assert len(got) == 48 and all(got[k] == v for k, v in truth.items())


def test_a_declared_zone_that_the_values_belie_is_not_believed(spark):
    rows = []
    for i in range(30):
        t = us(2026, 1, 1 + i % 28, 6, i)
        for raw in (D.datetime.fromtimestamp(t / 1e6, ZoneInfo("Asia/Tokyo")).strftime("%Y-%m-%d %H:%M:%S"), D.datetime.fromtimestamp(t / 1e6 + 5, D.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")):
            rows.append((i, "liar", raw, D.datetime.fromtimestamp(t / 1e6 + 60, D.timezone.utc), t))
    df = spark.createDataFrame(rows, "record_id long, source string, raw string, received_at timestamp, truth long")
    declared = spark.createDataFrame([("liar", "America/Denver", "ymd"), (" LIAR", None, None), (None, "UTC", "ymd")], "source string, time_zone string, day_month_order string")
    got = read_instants(df, "raw", declared, "source", "received_at", "record_id").collect()
    assert all(abs(r.start_us - r.truth) <= 5_000_000 for r in got)
    assert read_instants(df.limit(0), "raw", declared, "source", "received_at", "record_id").count() == 0
