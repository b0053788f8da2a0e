import pytest
from pyspark.sql import functions as F

from lexmill.operators import timestamps as T

NY, LON, BER, PHX = "America/New_York", "Europe/London", "Europe/Berlin", "America/Phoenix"
SITES = [("ny", NY, "mdy", "x"), ("lon", LON, "dmy", "x"), ("ber", BER, "dmy", "x"), ("phx", PHX, "mdy", "x")]
CASES = [
    ("ny", "2018-07-11T10:00:00Z", "2018-07-11T10:00:00Z"), ("ny", "2018-07-11 10:00:00", "2018-07-11T14:00:00Z"), ("ny", "2018-07-11T10:00", "2018-07-11T14:00:00Z"),
    ("ny", "7/11/2018", "2018-07-11"), ("lon", "7/11/2018", "2018-11-07"), ("lon", "13/11/18 09:05", "2018-11-13T09:05:00Z"), ("ny", "13/11/18 09:05", None),
    ("ny", "Wed, 11 Jul 2018 10:00:00 -0400", "2018-07-11T14:00:00Z"), ("ny", "July 11, 2018 at 6:51 p.m. EDT", "2018-07-11T22:51:00Z"), ("ny", "Jan. 11, 2018 12:05 AM ET", "2018-01-11T05:05:00Z"),
    ("ber", "22. Juni 2014, 05:37 Uhr", "2014-06-22T03:37:00Z"), ("ber", "3. März 2014", "2014-03-03"), ("lon", "Jun. 30, 2022 4:12 PM UK time", "2022-06-30T15:12:00Z"),
    ("phx", "2018-07-11 10:00:00", "2018-07-11T17:00:00Z"), ("ny", "1522399423516", "2018-03-30T08:43:43Z"), ("ny", "1614617752", "2021-03-01T16:55:52Z"),
    ("ny", "2014-11-02 01:30:00", "2014-11-02T05:30:00Z"), ("ny", "November 2, 2014 1:30 AM EST", "2014-11-02T06:30:00Z"), ("ny", "2014-03-09 02:30:00", "2014-03-09T07:30:00Z"),
    ("ny", "Published: Saturday, November 21, 2020 ", "2020-11-21"), ("ny", "Sept. 5th, 2018", "2018-09-05"), ("ny", "2018-07-11T10:00:00.123456+02:00", "2018-07-11T08:00:00Z"),
    ("ny", "2018-02-30", None), ("ny", "2018-13-01", None), ("ny", "2018-07-11 25:00", None), ("ny", "July 2018", None), ("ny", "TBD", None), ("ny", "", None), ("ny", None, None), ("ny", "2016-02-29", "2016-02-29"),
    ("ny", " 2018/7/1 ", "2018-07-01"), ("ny", "x" * 100_000, None),
]


def frames(spark, cases, stamps):
    a = spark.createDataFrame([(f"s{i}", site, d, "clash") for i, (site, d, _) in enumerate(cases)], "slug string, site string, date string, zone string")
    p = spark.createDataFrame([(i, f"s{i}", w, 1) for i, w in enumerate(stamps)], "prov_id bigint, slug string, wayback_timestamp string, local bigint")
    return a, p, spark.createDataFrame(SITES, "site string, tz string, date_order string, clock string")


def test_dates_and_stamps(spark):
    stamps = ["20150605201612", "20150605201612id_", "201506052016", "20150605", "201506", "20150231092827", "20150605256199", "20150605T201612Z", "2015-06-05T20:16:12+09:00", "2015-06-05 20:16:12", None, "", "live"]
    want = ["2015-06-05T20:16:12Z", "2015-06-05T20:16:12Z", "2015-06-05T20:16:00Z", "2015-06-05", None, None, None, "2015-06-05T20:16:12Z", "2015-06-05T11:16:12Z", "2015-06-05T20:16:12Z", None, None, None]
    a, p, s = frames(spark, CASES, stamps)
    rows = T.normalise(a.union(a.limit(3)), p, s).collect()
    got = {(r.field, r.row_key): r.normal_form for r in rows}
    assert len(got) == len(rows)
    for i, (site, d, form) in enumerate(CASES):
        assert got.get(("articles.date", f"s{i}")) == form, (site, d)
    for i, form in enumerate(want):
        assert got.get(("provenance.wayback_timestamp", str(i))) == form, stamps[i]
    assert T.normalise(a.limit(0), p.limit(0), s.limit(0)).count() == 0


def test_zones_query_uses_captures(spark, tmp_path):
    """A site whose values state no offset gets its zone from the captures of its pages."""
    from lexmill.plans.timestamps import p4_zones

    days = spark.range(0, 700, 9).select(F.col("id"), F.timestamp_add("HOUR", F.col("id") * 24 + F.col("id") % 24, F.expr("timestamp_ntz'2018-01-01 00:30:00'")).alias("local"))
    days.select(F.concat(F.lit("s"), "id").alias("slug"), F.lit("x").alias("site"), F.date_format("local", "yyyy-MM-dd HH:mm:ss").alias("date")).write.parquet(f"{tmp_path}/articles.parquet")
    at = F.timestamp_add("MINUTE", F.lit(40), T.to_utc(F.col("local"), F.lit(NY)))
    days.select("id", F.concat(F.lit("s"), "id").alias("slug"), F.date_format(at, "yyyyMMddHHmmss").alias("wayback_timestamp")).withColumnRenamed("id", "prov_id").write.parquet(f"{tmp_path}/provenance.parquet")
    spark.createDataFrame([("x", BER, "mdy")], "site string, tz string, date_order string").write.parquet(f"{tmp_path}/sites.parquet")
    got = p4_zones(spark, str(tmp_path)).first()
    assert got.zone is not None and got.evidence == days.count() and got.declared == BER


@pytest.mark.parametrize("zone", [NY, LON, BER, PHX])
def test_zone_is_estimated_from_stated_offsets_and_ingestion(spark, zone):
    days = spark.range(0, 700, 9).select(F.timestamp_add("HOUR", F.col("id") * 24 + F.col("id") % 24, F.expr("timestamp_ntz'2018-01-01 00:30:00'")).alias("local"))
    utc = T.to_utc(F.col("local"), F.lit(zone))
    minutes = F.timestamp_diff("MINUTE", utc, F.col("local"))
    off = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    stated = days.select(F.lit("x").alias("source"), "local", off.alias("zone"), F.lit(None).cast("timestamp_ntz").alias("seen"))
    bare = days.select(F.lit("x").alias("source"), "local", F.lit(None).cast("string").alias("zone"), F.timestamp_add("MINUTE", F.lit(40), utc).alias("seen"))
    none = spark.createDataFrame([("x", None)], "source string, zone string")
    got = T.estimate_zones(stated.unionByName(bare), none).first()
    assert got.zone == zone and got.violations == 0 and got.evidence > 0
    # Without evidence the declared zone stands; without either there is none.
    quiet = days.limit(2).select(F.lit("q").alias("source"), "local", F.lit(None).cast("string").alias("zone"), F.lit(None).cast("timestamp_ntz").alias("seen"))
    assert T.estimate_zones(quiet, spark.createDataFrame([("q", BER)], "source string, zone string")).first().zone == BER
    assert T.estimate_zones(quiet, none).first().zone is None


def test_undeclared_zones_from_lags_on_both_sides(spark):
    """Captures up to seventeen hours after publication, for zones of one standard offset with and without summer time."""
    zones = [NY, "America/Chicago", "America/Denver", "America/Los_Angeles", BER, PHX, "Asia/Kolkata", "Asia/Tokyo"]
    n = spark.range(0, 4000).withColumn("utc", F.timestamp_add("MINUTE", (F.col("id") * 263 + 7919 * F.pmod(F.xxhash64("id"), F.lit(97))).cast("int"), F.expr("timestamp_ntz'2016-01-01 00:00:00'")))
    n = n.withColumn("source", F.explode(F.array(*[F.lit(z) for z in zones])))
    stamps = n.select("source", F.convert_timezone(F.lit("UTC"), F.col("source"), F.col("utc")).alias("local"), F.lit(None).cast("string").alias("zone"), F.timestamp_add("MINUTE", F.pmod(F.xxhash64("id", "source"), F.lit(17 * 60)).cast("int"), F.col("utc")).alias("seen"))
    none = spark.createDataFrame([(z, None) for z in zones], "source string, zone string")
    got = {r.source: r for r in T.estimate_zones(stamps, none).collect()}
    probe = spark.range(365 * 3).select(F.timestamp_add("DAY", F.col("id").cast("int"), F.expr("timestamp_ntz'2016-01-01 12:00:00'")).alias("t"))
    for z in zones:  # the history, whatever name it goes by
        assert probe.where(T.to_utc(F.col("t"), F.lit(z)) != T.to_utc(F.col("t"), F.lit(got[z].zone))).count() == 0, (z, got[z])
        assert got[z].violations <= 0.01 * got[z].evidence
    assert {z: got[z].zone for z in zones[:6]} == {z: z for z in zones[:6]}


def test_declared_zone_is_overruled_by_violations_only(spark):
    days = spark.range(0, 500).select(F.timestamp_add("HOUR", F.col("id") * 25, F.expr("timestamp_ntz'2018-01-01 00:30:00'")).alias("local"))
    late = days.select(F.lit("x").alias("source"), "local", F.lit(None).cast("string").alias("zone"), F.timestamp_add("HOUR", F.lit(20), T.to_utc(F.col("local"), F.lit(NY))).alias("seen"))
    one = lambda z: T.estimate_zones(late, spark.createDataFrame([("x", z)], "source string, zone string")).first()
    assert one(NY).zone == NY and one(BER).zone == BER
    early = late.withColumn("seen", F.timestamp_add("HOUR", F.lit(-18), F.col("seen")))
    assert T.estimate_zones(early, spark.createDataFrame([("x", "Pacific/Honolulu")], "source string, zone string")).first().zone != "Pacific/Honolulu"
