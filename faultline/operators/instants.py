"""Timestamps of many forms and zones to one UTC instant, in Catalyst expressions only.

A value is read in three steps: its form gives a local date and time (or an epoch number), its suffix gives
an offset, a zone name or an abbreviation, and where it has none the zone of its source is used. Zones of
sources are settled by their values: a candidate zone (an offset history) converts the source's zoneless
values, a violation is a start after its record was received or outside the span of the record's zoned starts, and the
history with the fewest violations wins. A declared zone is tried first and stands unless most values violate it.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.runtime import bounded_broadcast, canonical_source, cut

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_US = 86_400_000_000
#: How far outside the zoned starts of its record a start may lie, in microseconds (zones differ by 15 minutes at least).
SLACK_US = 10 * 60 * 1_000_000
#: A declared zone that more than this share of its source's zoneless values violate is not believed.
DISTRUST = 0.5


def abbreviations(zones: list[str]) -> dict[str, int]:
    """'zone|ABBREVIATION' to its offset in seconds, out of the zones' own histories of 1990 to 2040, and UTC's."""
    out: dict[str, int] = {}
    for name in zones:
        if name not in available_timezones():
            continue
        zone, t = ZoneInfo(name), datetime(1990, 1, 1, tzinfo=timezone.utc)
        while t.year < 2040:
            local = t.astimezone(zone)
            if (abbr := local.tzname()) and abbr[0].isalpha():
                out[f"{name}|{abbr.upper()}"] = int(local.utcoffset().total_seconds())
            t += timedelta(days=13)
    return out


def parse_instant(rows: DataFrame, raw: str, order: str) -> DataFrame:
    """rows with __epoch_us, __local_us, __offset_s and __zone_text, all null where raw is no time.

    __epoch_us: of a plain number, seconds to nanoseconds by its size, finer digits cut off. __local_us: the
    date and time as written, as if in UTC. __offset_s: a numeric offset, 0 for Z. __zone_text: a zone's name or
    abbreviation. order names the column with dmy, mdy or ymd for dates in figures; null counts as ymd.

    Every form is first rewritten to one canonical list of parts, so that the arithmetic is written once.
    """
    cols = rows.columns
    time = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?"
    tail = r"\s*(?:([Zz])|([+-]\d{2}:?\d{2}|[+-]\d{2})|([A-Za-z][A-Za-z_+\-/]*\d*))?\s*(?:\[([^\]]+)\])?$"
    parts = "$4|$5|$6|$7|$8|$9|$10|$11|$12"
    forms = [
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt]|\s+)" + time + tail, f"ymd|$1|$2|$3|{parts}"),
        (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[Tt]|,?\s+)" + time + tail, f"figures|$3|$2|$1|{parts}"),
        (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[-\s]([A-Za-z]{3,9})[-\s](\d{4}),?\s+" + time + tail, f"name|$3|$2|$1|{parts}"),
        (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?()" + tail, f"ymd|$1|$2|$3|{parts}"),
    ]
    rows = rows.withColumn("__s", F.regexp_replace(F.col(raw), r"(?U)^\s+|\s+$", ""))
    s = F.col("__s")
    canon = F.when(s.rlike(r"^[+-]?\d{1,19}(\.\d*)?$"), F.regexp_replace(s, r"^([+-]?\d+)(?:\.(\d*))?$", "number|$1|$2"))
    for pattern, to in forms:
        canon = canon.when(s.rlike(pattern), F.regexp_replace(s, pattern, to))
    rows = rows.withColumn("__p", F.split(canon, r"\|"))
    p = lambda i: F.get("__p", F.lit(i))
    num = lambda i: p(i).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(p(2), 1, 3))).cast("int")
    swap = (p(0) == "figures") & F.col(order).eqNullSafe("mdy")
    rows = rows.withColumns({
        "__is_number": p(0) == "number",
        "__m": F.when(p(0) == "name", month).when(swap, num(3)).otherwise(num(2)),
        "__d": F.when(swap, num(2)).otherwise(num(3)),
        "__h": F.when(F.lower(p(8)) == "pm", num(4) % 12 + 12).when(F.lower(p(8)) == "am", num(4) % 12).otherwise(num(4)),
        "__sec": F.coalesce(num(6), F.lit(0)),
        "__frac": F.when(F.coalesce(p(7), F.lit("")) == "", F.lit(0)).otherwise(F.rpad(F.substring(p(7), 1, 6), 6, "0").try_cast("int")),
        "__digits": F.rpad(F.regexp_replace(F.substring(p(10), 2, 5), ":", ""), 4, "0"),
        "__n": F.when(p(0) == "number", p(1).try_cast("bigint")),
        "__sub": F.when(F.coalesce(p(2), F.lit("")) == "", F.lit(0)).otherwise(F.rpad(F.substring(p(2), 1, 6), 6, "0").try_cast("int")) * F.when(p(1).startswith("-"), -1).otherwise(1),
    })
    day = F.unix_date(F.format_string("%s-%02d-%02d", p(1), F.col("__m"), F.col("__d")).try_cast("date")).cast("bigint")
    ok = (F.col("__h") < 24) & (num(5) < 60) & (F.col("__sec") < 61)
    local = F.when(~F.col("__is_number") & ok, day * DAY_US + ((F.col("__h") * 60 + num(5)).cast("bigint") * 60 + F.col("__sec")) * 1_000_000 + F.col("__frac"))
    n, size, sub = F.col("__n"), F.abs("__n"), F.col("__sub")
    epoch = F.when(size < 10**11, n * 1_000_000 + sub).when(size < 10**14, n * 1000 + F.floor(sub / 1000)).when(size < 10**17, n).otherwise(F.expr("__n div 1000"))
    seconds = (F.substring("__digits", 1, 2).try_cast("int") * 3600 + F.substring("__digits", 3, 2).try_cast("int") * 60) * F.when(p(10).startswith("-"), -1).otherwise(1)
    offset = F.when(~F.col("__is_number"), F.when(p(9) != "", F.lit(0)).when(p(10) != "", seconds))
    zone = F.when(~F.col("__is_number"), F.when(p(12) != "", p(12)).when(p(11) != "", p(11)))
    return rows.select(*cols, epoch.alias("__epoch_us"), local.alias("__local_us"), offset.cast("bigint").alias("__offset_s"), zone.alias("__zone_text"))


def _zone_us(local_us: Column, zone: Column) -> Column:
    """UTC microseconds of a local time: in a repeated hour the earlier instant, in a skipped one the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def read_instants(rows: DataFrame, raw: str, sources: DataFrame, source: str, received: str | None = None, record: str | None = None) -> DataFrame:
    """rows with start_us (bigint, null where raw cannot be read) and zone_used.

    sources: source, time_zone, day_month_order; of rows of one source the greatest counts. With received and record the zone
    of every source is the offset history that its values violate least: a declared zone stands unless more than DISTRUST of the
    values violate it, a null, unknown or distrusted one is estimated among all candidates, and so is that of a source
    that sources lacks. Without them such a source reads as UTC, as does a row without a source. Session zone: UTC.
    """
    cols, spark = rows.columns, sources.sparkSession
    valid = F.broadcast(spark.createDataFrame([(z,) for z in sorted(available_timezones())], "__valid string"))  # some 600 names
    spec = sources.where("source is not null").groupBy(canonical_source(F.col("source")).alias("__source")).agg(F.max(F.struct("time_zone", "day_month_order")).alias("s"))
    spec = cut(spec.join(valid, F.col("s.time_zone") == F.col("__valid"), "left").select("__source", F.col("__valid").alias("__declared"), F.col("s.day_month_order").alias("__order")))
    read = rows.withColumn("__source", canonical_source(F.col(source))).join(bounded_broadcast(spec), "__source", "left")
    read = parse_instant(read.select(*cols, "__source", "__declared", "__order"), raw, "__order")
    zone = spec.select(F.col("__source").alias("__of"), F.col("__declared").alias("__zone"))
    if received and record:
        read = cut(read)  # parsed once, for the estimates and the result
        best = settle_zones(read.where("__source is not null"), received, record)
        zone = cut(best.select(F.col("__source").alias("__of"), F.col("zone").alias("__zone")).unionByName(zone.join(best, F.col("__of") == F.col("__source"), "left_anti")))
    read = read.drop("__zone").join(bounded_broadcast(zone), F.col("__source") == F.col("__of"), "left")
    zones = sorted({"UTC"} | {r["__zone"] for r in zone.select("__zone").distinct().collect() if r["__zone"]})  # at most all zones there are
    # a few rows for each of the zones of the sources
    offsets = spark.createDataFrame([(k, v) for k, v in abbreviations(zones).items()], "__abbr string, __abbr_s int")
    text = F.col("__zone_text")
    named = F.when(text.contains("/"), text)
    read = read.select(
        *cols, "__epoch_us", "__local_us", "__offset_s", "__zone_text", F.when(named.isin(*zones), named).otherwise(F.coalesce("__zone", F.lit("UTC"))).alias("zone_used"),
        F.when(text.isNotNull() & named.isNull(), F.concat_ws("|", F.when(F.upper(text).isin("UTC", "GMT", "Z", "UT"), F.lit("UTC")).otherwise(F.coalesce("__zone", F.lit("UTC"))), F.when(F.upper(text).isin("UTC", "GMT", "Z", "UT"), F.lit("UTC")).otherwise(F.upper(text)))).alias("__key"),
    ).join(bounded_broadcast(offsets), F.col("__key") == F.col("__abbr"), "left")
    explicit = F.coalesce("__offset_s", "__abbr_s")
    # an abbreviation that is neither UTC's nor the source's zone's cannot be read
    local = F.when(F.col("__key").isNull(), _zone_us(F.col("__local_us"), F.col("zone_used")))
    start = F.coalesce("__epoch_us", F.col("__local_us") - explicit * 1_000_000, local)
    return read.select(*cols, start.alias("start_us"), F.when(F.col("__epoch_us").isNull() & explicit.isNull() & F.col("__key").isNull() & F.col("__local_us").isNotNull(), F.col("zone_used")).alias("zone_used"))


def candidates(spark: SparkSession) -> list[str]:
    """Every zone an undeclared source may be in: the IANA names of the form area/place that Spark knows too, and UTC."""
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(z for z in available_timezones() & known if z == "UTC" or "/" in z and not z.startswith(("Etc/", "SystemV/")))


def settle_zones(read: DataFrame, received: str, record: str) -> DataFrame:
    """Per source with zoneless values its zone: the declared one (__declared) where it stands, else the best of all candidates."""
    lines = cut(record_lines(read, received, record))
    own = estimate_zones(lines, F.array("__declared"))
    stands = own.where(F.col("zone").isNotNull() & (F.col("violations") <= DISTRUST * F.col("values")))
    doubtful = lines.join(stands.select(F.col("__source").alias("__ok")), F.col("__source") == F.col("__ok"), "left_anti")
    found = estimate_zones(doubtful, F.array(*map(F.lit, candidates(read.sparkSession))))
    return stands.unionByName(found)


def record_lines(read: DataFrame, received: str, record: str) -> DataFrame:
    """One row per record and source: what its zoned and zoneless starts span. read: rows of parse_instant."""
    fixed = F.coalesce(F.col("__epoch_us"), F.col("__local_us") - F.col("__offset_s") * 1_000_000)
    bare = F.col("__local_us").isNotNull() & F.col("__offset_s").isNull() & F.col("__zone_text").isNull()
    declared = F.max("__declared") if "__declared" in read.columns else F.lit(None).cast("string")
    return read.groupBy("__source", record).agg(
        F.min(fixed).alias("lo"), F.max(fixed).alias("hi"), F.max(F.unix_micros(F.col(received))).alias("received_us"),
        F.min(F.when(bare, F.col("__local_us"))).alias("bare_lo"), F.max(F.when(bare, F.col("__local_us"))).alias("bare_hi"), F.count(F.when(bare, 1)).alias("n"), declared.alias("__declared"),
    ).where("n > 0")


def estimate_zones(lines: DataFrame, zones: Column) -> DataFrame:
    """Per source the zone of the array zones with the fewest violations: __source, zone, violations, values.

    lines: rows of record_lines. One pass that adds up violations of all candidates, then one row per source and zone. Ties go to the
    smaller mean distance to the zoned starts of the record, then by name.
    """
    tried = lines.withColumn("zone", F.explode_outer(zones))
    lo, hi = _zone_us(F.col("bare_lo"), F.col("zone")), _zone_us(F.col("bare_hi"), F.col("zone"))
    late = F.coalesce(hi > F.col("received_us"), F.lit(False))
    away = F.coalesce((hi > F.col("hi") + 6 * SLACK_US) | (lo < F.col("lo") - 6 * SLACK_US), F.lit(False))
    distance = F.coalesce(F.abs((lo + hi) / 2 - (F.col("lo") + F.col("hi")) / 2), (F.col("received_us") - hi).cast("double"))
    scored = tried.groupBy("__source", "zone").agg(F.sum(F.when(late | away, F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("values"), F.avg(F.least(distance, F.lit(6.0 * 3.6e9))).alias("distance"))
    return scored.groupBy("__source").agg(F.min(F.struct("violations", "distance", "zone", "values")).alias("b")).select("__source", "b.zone", "b.violations", "b.values")
