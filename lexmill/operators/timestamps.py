"""Mixed timestamp notations and zones, brought to one form (problem 4).

A value is parsed by declarative patterns on the JVM side into date parts, an optional time and an optional zone.
A time without zone is on the clock of its source.  That clock is an *offset history* (an IANA zone): for every
source all histories are scored by what they violate.  A value that states its own offset contradicts a history, and so
does a converted instant after the time at which the value was ingested; one long before it isn't impossible, but costs by
the hour, so of the histories without violations the one wins that lies tightest under the ingestion times, in summer and
in winter.  A declared zone is only overruled by violations.  Then the local time is converted.

Nulls, empty texts and values without a full, possible date give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import cut

# Month names (English, German, French, Spanish) by month.
MONTHS = [
    "january|jan|januar|jänner|janvier|janv|enero|ene",
    "february|feb|februar|février|févr|febrero",
    "march|mar|märz|mrz|mars|marzo",
    "april|apr|avril|avr|abril|abr",
    "may|mai|mayo",
    "june|jun|juni|juin|junio",
    "july|jul|juli|juillet|juil|julio",
    "august|aug|août|agosto|ago",
    "september|sept|sep|septembre|septiembre",
    "october|oct|oktober|okt|octobre|octubre",
    "november|nov|novembre|noviembre",
    "december|dec|dezember|dez|décembre|déc|diciembre|dic",
]
# Zone names with a season, as offsets.
OFFSETS = {
    "z": "+00:00", "ut": "+00:00", "utc": "+00:00", "gmt": "+00:00",
    "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00",
    "pst": "-08:00", "pdt": "-07:00", "akst": "-09:00", "akdt": "-08:00", "hst": "-10:00", "ast": "-04:00",
    "adt": "-03:00", "nst": "-03:30", "ndt": "-02:30", "wet": "+00:00", "west": "+01:00", "bst": "+01:00",
    "ist": "+01:00", "cet": "+01:00", "cest": "+02:00", "mez": "+01:00", "mesz": "+02:00", "eet": "+02:00",
    "eest": "+03:00", "msk": "+03:00",
}
# Zone names without a season, as the region's clock.
REGIONS = {
    "et": "America/New_York", "eastern": "America/New_York", "ct": "America/Chicago", "central": "America/Chicago",
    "mt": "America/Denver", "mountain": "America/Denver", "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles",
    "akt": "America/Anchorage", "alaska": "America/Anchorage", "ht": "Pacific/Honolulu", "hawaii": "Pacific/Honolulu",
    "at": "America/Halifax", "atlantic": "America/Halifax", "nt": "America/St_Johns", "newfoundland": "America/St_Johns",
    "uk": "Europe/London", "british": "Europe/London", "london": "Europe/London", "irish": "Europe/Dublin",
    "german": "Europe/Berlin", "berlin": "Europe/Berlin", "paris": "Europe/Paris",
}
# Of histories that agree wherever a source has values, the one that gives its name, in this order; then by name.
CANDIDATES = [
    "UTC", "America/New_York", "America/Chicago", "America/Denver", "America/Phoenix", "America/Los_Angeles",
    "America/Anchorage", "America/Halifax", "Europe/London", "Europe/Berlin", "Europe/Athens",
]

_DAY = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonnabend|sonntag|mo|di|mi|do|fr|sa|so"
_MONTH = "(" + "|".join(MONTHS) + ")"
_ZONE = r"\(?(z|[+-]\d{1,2}:?\d{2}|[+-]\d{2}|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|" + "|".join(sorted({*OFFSETS, *REGIONS} - {"z"}, key=lambda x: (-len(x), x))) + r")\)?(?: (?:standard |summer |daylight )?time)?"
_TIME = r"(?:(?:t|,? ?(?:at |um |à |a las |@ ?|[-–|] ?)?))?(\d{1,2})[:.h](\d{2})(?::(\d{2})(?:[.,]\d+)?)? ?(a\.?m\.?|p\.?m\.?)? ?(?:uhr|hrs?|h)? ?(?:" + _ZONE + ")?"
_LEAD = r"^(?:(?:published|updated|posted|last updated|date)(?: on)?:? ?)?(?:(?:" + _DAY + r")\.?,? )?"
_ORD = r"(?:st|nd|rd|th|\.)?"

#: (name, pattern, replacement with the parts year|month|day|hour|minute|second|am or pm|zone|kind)
_PATTERNS = [
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)? ?(z|[+-]\d{2}:?\d{2})?)?(?:[a-z]{2}_)?$", "$1|$2|$3|$4|$5|$6||$7|"),
    ("ymd", _LEAD + r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:" + _TIME + ")?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    ("dmy", _LEAD + r"(\d{1,2})" + _ORD + r"(?: of| de)?[ -]" + _MONTH + r"\.?,?(?: de)?[ -](\d{4}|\d{2})(?:" + _TIME + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    ("mdy", _LEAD + _MONTH + r"\.? (\d{1,2})" + _ORD + r",? (\d{4})(?:" + _TIME + ")?$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
    ("num", _LEAD + r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?:" + _TIME + ")?$", "$3|$1|$2|$4|$5|$6|$7|$8|n"),
]


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions and filters read instead of repeating their terms (a generator is a barrier)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def parse_stamps(df: DataFrame, value: str, date_order: str | None = None) -> DataFrame:
    """Add local (timestamp_ntz), timed (boolean) and zone (string); rows whose value gives no full date are left out.

    date_order: column with 'mdy' or 'dmy' for all-numeric dates; where it is null such a date counts only if one order is possible.
    zone: an offset, a region, or null where the text names none.
    """
    keep = df.columns
    df = _stage(df, _t=F.lower(F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0\u202f\u2009]+", " "))))
    t = F.col("_t")
    epoch = F.when(t.rlike(r"^\d{10}$"), t.try_cast("bigint")).when(t.rlike(r"^\d{13}$"), F.substring(t, 1, 10).try_cast("bigint"))
    parts = reduce(lambda acc, p: acc.when(t.rlike(p[1]), F.split(F.regexp_replace(t, p[1], p[2]), r"\|")), _PATTERNS, F.when(F.lit(False), F.array().cast("array<string>")))
    df = _stage(df, _epoch=epoch, _p=parts)
    at = [F.get(F.col("_p"), F.lit(i)) for i in range(9)]
    month_no = reduce(lambda acc, i: acc.when(at[1].rlike(f"^(?:{MONTHS[i]})$"), i + 1), range(12), F.when(F.lit(False), 0))
    order = F.col(date_order) if date_order else F.lit(None).cast("string")
    df = _stage(df, _y=_int(at[0]), _a=F.coalesce(_int(at[1]), month_no), _b=_int(at[2]), _h=_int(at[3]), _mi=_int(at[4]), _s=F.when(at[5] == "", 0).otherwise(_int(at[5])),
                _ap=F.regexp_replace(at[6], r"\.", ""), _z=F.when(at[7] != "", F.regexp_replace(at[7], "^(?:utc|gmt)(?=[+-])", "")), _timed=at[3] != "", _num=at[8] == "n", _order=order)
    c = F.col
    swap = c("_num") & F.coalesce(c("_order") == "dmy", c("_a") > 12)
    known = ~c("_num") | c("_order").isNotNull() | (c("_a") > 12) | (c("_b") > 12)
    digits = F.regexp_replace(c("_z"), r"[^\d]", "")
    df = _stage(df, _year=F.when(c("_y") < 100, c("_y") + 2000).otherwise(c("_y")), _month=F.when(swap, c("_b")).otherwise(c("_a")), _day=F.when(swap, c("_a")).otherwise(c("_b")), _known=known,
                _hour=F.when(c("_ap") == "am", F.when(c("_h").between(1, 12), c("_h") % 12)).when(c("_ap") == "pm", F.when(c("_h").between(1, 12), c("_h") % 12 + 12)).otherwise(c("_h")),
                _off=F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0")), _isoff=F.coalesce(c("_z").rlike(r"^[+-]\d"), F.lit(False)))
    named = F.create_map(*[F.lit(x) for kv in {**OFFSETS, **REGIONS}.items() for x in kv])
    on = c("_timed")
    good = c("_known") & c("_year").between(1900, 2199) & (~on | (c("_hour").between(0, 23) & c("_mi").between(0, 59) & c("_s").between(0, 59)))
    good = good & (~c("_isoff") | ((F.substring("_off", 1, 2).try_cast("int") <= 14) & (F.substring("_off", 3, 2).try_cast("int") < 60)))
    stated = F.when(good, F.try_make_timestamp_ntz(c("_year"), c("_month"), c("_day"), F.when(on, c("_hour")).otherwise(0), F.when(on, c("_mi")).otherwise(0), F.when(on, c("_s")).otherwise(0).cast("decimal(16,6)")))
    zone = F.when(c("_isoff"), F.concat(F.substring("_z", 1, 1), F.substring("_off", 1, 2), F.lit(":"), F.substring("_off", 3, 2))).otherwise(F.try_element_at(named, c("_z")))
    e = c("_epoch").isNotNull()
    df = _stage(df, local=F.when(e, F.timestamp_add("SECOND", c("_epoch"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))).otherwise(stated), timed=F.coalesce(e | on, F.lit(False)), zone=F.when(e, F.lit("+00:00")).otherwise(zone))
    return df.where("local is not null").select(*keep, "local", "timed", "zone")


def to_utc(local: Column, zone: Column) -> Column:
    """UTC of a local time; of two readings the earlier instant, of a skipped time the one by the offset before."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


def render(local: Column, timed: Column, zone: Column) -> Column:
    """The one form: a UTC second with time, a calendar date without; null where the zone isn't known."""
    utc = F.when(timed & zone.isNotNull(), to_utc(local, F.coalesce(zone, F.lit("UTC"))))
    return F.when(timed, F.concat(F.translate(F.substring(utc.cast("string"), 1, 19), " ", "T"), F.lit("Z"))).otherwise(F.substring(local.cast("string"), 1, 10))


def histories(spark: SparkSession) -> list[str]:
    """All IANA zones that are named after a place, and UTC."""
    areas = ("Africa/", "America/", "Antarctica/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    return ["UTC", *sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if z.startswith(areas))]


def _offset(local: Column, zone: Column) -> Column:
    """Minutes by which a local clock is ahead of UTC."""
    return F.timestamp_diff("MINUTE", to_utc(local, zone), local)


def estimate_zones(stamps: DataFrame, declared: DataFrame, violation: float = 96.0, trust: float = 0.02) -> DataFrame:
    """For each source its most plausible offset history.

    stamps: source, local (timestamp_ntz), zone (offset or region stated by the value, or null), seen (ingestion time in
    UTC as timestamp_ntz, or null).  declared: source, zone (null allowed).
    Result: source, zone, declared, evidence (values that could contradict), violations (of zone).

    A violation costs as much as ``violation`` hours of lag; values count that state an offset or were ingested less than two days
    from their local time.  A declared zone stands unless it has more than twice the best history's violations and
    ``trust`` of the evidence beyond.  A source without evidence keeps its declared zone; without either its zone is null.

    Every value counts.  Values of one hour, stated offset and quarter hour of lag are first counted together, so a source with
    a third of the rows is no hot spot; histories are scored by week, which every zone keeps one offset in but for the hours
    around a change, and the chosen and the declared one are then held against each hour."""
    spark = stamps.sparkSession
    base = stamps.select("source", "local", "zone", "seen").where("local is not null and source is not null")
    if declared is not None:
        base = base.join(declared.groupBy("source").agg(F.min("zone").alias("declared")), "source", "left")
    else:
        base = base.withColumn("declared", F.lit(None).cast("string"))
    says = F.when(F.col("zone").rlike(r"^[+-]") & ~F.col("zone").isin("+00:00", "-00:00"), _offset(F.col("local"), F.col("zone")))
    ahead = F.timestamp_diff("MINUTE", F.col("local"), F.col("seen"))
    lag = F.when(F.col("zone").isNull() & ahead.between(-26 * 60, 48 * 60), F.floor(ahead / 15) * 15)  # offsets are quarter hours, so this is exact
    told = base.select("source", "declared", "local", says.alias("says"), lag.alias("lag")).withColumn("tells", F.col("says").isNotNull() | F.col("lag").isNotNull())
    hour = F.when(F.col("tells"), F.date_trunc("hour", "local").cast("timestamp_ntz"))
    hours = cut(told.groupBy("source", "declared", hour.alias("local"), "says", "lag").agg(F.count("*").alias("n")), "hours")
    week = F.date_trunc("week", "local").cast("timestamp_ntz")
    hist = hours.where("local is not null").groupBy("source", week.alias("week"), "says", "lag").agg(F.sum("n").alias("n"))
    zones = histories(spark)
    middle = F.timestamp_add("HOUR", F.lit(84), F.col("week"))
    grid = hist.select("week").distinct().withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones])))
    grid = cut(grid.select("week", "zone", _offset(middle, F.col("zone")).alias("offset")), "grid")  # zones x weeks
    off = F.col("lag") + F.col("offset")
    cost = F.when(F.col("says").isNotNull(), F.when(F.col("says") != F.col("offset"), violation).otherwise(0.0)).when(off < 0, violation).otherwise(off / 60)
    weekly = hist.join(grid.select("week", "offset").distinct(), "week").groupBy("source", "week", "offset").agg(F.sum(cost * F.col("n")).alias("cost"))
    place = {z: i for i, z in enumerate(CANDIDATES)}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("zone")), F.lit(len(place)))
    scores = weekly.join(grid, ["week", "offset"]).groupBy("source", "zone").agg(F.round(F.sum("cost"), 3).alias("cost"))
    best = scores.groupBy("source").agg(F.min(F.struct("cost", rank.alias("rank"), "zone")).alias("b")).select("source", F.col("b.zone").alias("best"))
    held = hours.join(best, "source", "left").select("*", F.explode(F.array_distinct(F.array(F.coalesce("declared", "best"), "best"))).alias("cand"))
    exact = _offset(F.col("local"), F.col("cand"))
    bad = F.when(F.col("says").isNotNull(), F.col("says") != exact).otherwise(F.col("lag") + exact < 0)
    count = lambda c: F.coalesce(F.sum(F.when(F.col("local").isNotNull() & c, F.col("n"))), F.lit(0))
    seen = held.groupBy("source", "declared", "best", "cand").agg(count(F.lit(True)).alias("evidence"), count(bad).alias("violations"))
    own = F.col("cand") == F.col("best")
    both = seen.groupBy("source", "declared", "best").agg(
        F.max("evidence").alias("evidence"), F.max(F.when(own, F.col("violations"))).alias("v"), F.max(F.when(F.coalesce(F.col("cand") == F.col("declared"), F.lit(False)), F.col("violations"))).alias("dv")
    )
    stands = F.col("declared").isNotNull() & (F.col("best").isNull() | (F.col("dv") <= 2 * F.col("v") + trust * F.col("evidence")))
    return both.select("source", F.when(stands, F.col("declared")).otherwise(F.col("best")).alias("zone"), "declared", "evidence", F.coalesce(F.when(stands, F.col("dv")).otherwise(F.col("v")), F.lit(0)).alias("violations"))


def first_seen(captures: DataFrame) -> DataFrame:
    """slug, seen: the earliest instant of a slug's captures, which are parsed with ``parse_stamps``."""
    return captures.where("timed").groupBy("slug").agg(F.min(to_utc(F.col("local"), F.coalesce("zone", F.lit("UTC")))).alias("seen"))


def normalise(articles: DataFrame, provenance: DataFrame, sites: DataFrame) -> DataFrame:
    """field, row_key, normal_form of articles.date and provenance.wayback_timestamp (see the module's docstring).

    Repeated rows count once; values that give no date are left out; a site that is not in sites gets an estimated zone.
    """
    place = sites.groupBy("site").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    a = articles.select("slug", "site", "date").where("date is not null and slug is not null").distinct().join(place, "site", "left")
    a = parse_stamps(a, "date", "date_order").select("slug", "site", "local", "timed", "zone")
    w = provenance.select("prov_id", "slug", "wayback_timestamp").where("wayback_timestamp is not null").distinct()
    w = parse_stamps(w.withColumn("ord", F.lit("mdy")), "wayback_timestamp", "ord")
    captured = first_seen(w)
    stamps = a.where("timed").join(captured, "slug", "left").select(F.col("site").alias("source"), "local", "zone", "seen")
    zones = estimate_zones(stamps, place.select(F.col("site").alias("source"), F.col("tz").alias("zone")))
    clock = zones.select(F.col("source").alias("site"), F.col("zone").alias("clock"))
    dates = a.join(clock, "site", "left").select(
        F.lit("articles.date").alias("field"), F.col("slug").alias("row_key"), render(F.col("local"), F.col("timed"), F.coalesce("zone", "clock")).alias("normal_form")
    )
    stamps_out = w.select(F.lit("provenance.wayback_timestamp").alias("field"), F.col("prov_id").cast("string").alias("row_key"), render(F.col("local"), F.col("timed"), F.coalesce("zone", F.lit("UTC"))).alias("normal_form"))
    return dates.unionByName(stamps_out).where("normal_form is not null and row_key is not null").distinct()
