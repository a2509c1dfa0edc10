"""Problem 1: instants in mixed notations and zones become UTC microseconds.

All notations are compiled into one regular expression with named groups. It runs
once per value (a single ``regexp_replace`` that emits every component), calendar
ranges are checked, and the instant is assembled by integer day arithmetic. The
zone rules come from the JVM's time-zone database. Everything stays in code
generated by Spark; there is no Python in the path.

Defined results: null, empty, relative words, impossible dates or times, unknown
zone names or abbreviations, and wall times skipped by their zone give null. A wall
time that occurred twice means its first occurrence. A null or blank zone column
means UTC. A weekday in front of a date is not compared with the date. ``UTC`` or ``GMT``
with an offset means the offset. A bare date and a date by week numbers name no instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180, "AST": -240, "ADT": -180, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"

#: Date notations; a group name is a component plus the number of its notation.
_DATES = [
    r"(?<y1>\d{4})-(?<m1>\d{2})-(?<d1>\d{2})(?:[Tt]| +)",
    r"(?<y2>\d{4})-(?<j2>\d{3})(?:[Tt]| +)",
    r"(?<d3>\d{1,2})\.(?<m3>\d{1,2})\.(?<y3>\d{4})(?:[Tt]|,? +)",
    r"(?<m4>\d{1,2})/(?<d4>\d{1,2})/(?<y4>\d{4})(?:[Tt]|,? +)",
    r"(?<d5>\d{1,2})/(?<b5>[A-Za-z]{3})/(?<y5>\d{4})(?::| +)",
    r"(?:[A-Za-z]{3,9}\.?,? +)?(?<d6>\d{1,2})[ -](?<b6>[A-Za-z]{3})[a-z]*[ -](?<y6>\d{4}),? +",
    r"(?:[A-Za-z]{3,9}\.?,? +)?(?<b7>[A-Za-z]{3})[a-z]* +(?<d7>\d{1,2}),? +(?<y7>\d{4}),? +",
    r"(?<y9>\d{4})/(?<m9>\d{1,2})/(?<d9>\d{1,2})(?:[Tt]| +)",
]
_ZONE = r"(?:(?<zo>[+-]\d{2}(?::?\d{2})?)|(?:UTC|GMT)(?<zg>[+-]\d{1,2}(?::\d{2})?))(?:\[[A-Za-z0-9_/+-]+\])?|(?<za>[A-Za-z]{1,5})(?:\[[A-Za-z0-9_/+-]+\])?|\[?(?<zn>[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?"
ALTERNATION = (
    r"^\s*(?:(?:" + "|".join(_DATES) + r")"
    r"(?<H1>\d{1,2}):(?<M1>\d{2})(?::(?<S1>\d{2})(?:[.,](?<f1>\d{1,9}))?)?(?: ?(?<p1>[AaPp])\.?[Mm](?![A-Za-z/_])\.?)?"
    r"(?: *(?:" + _ZONE + r"))?"
    r"|(?<y8>\d{4})(?<m8>\d{2})(?<d8>\d{2})[Tt](?<H8>\d{2})(?<M8>\d{2})(?<S8>\d{2})?(?:[.,](?<f8>\d{1,9}))?"
    r"(?:(?<zo8>[+-]\d{2}(?::?\d{2})?)|(?<za8>[A-Za-z]{1,5}))?"
    r"|(?<e1>\d{10}|\d{13}|\d{16}|\d{19})|(?<e2>\d{10})[.,](?<f2>\d{1,9})"
    r")\s*$"
)
_SEP = "\u0001"
#: Component -> the groups that can hold it; at most one of them matches.
_COMPONENTS = {
    "y": ["y1", "y2", "y3", "y4", "y5", "y6", "y7", "y8", "y9"],
    "m": ["m1", "m3", "m4", "m8", "m9"],
    "b": ["b5", "b6", "b7"],
    "d": ["d1", "d3", "d4", "d5", "d6", "d7", "d8", "d9"],
    "j": ["j2"],
    "H": ["H1", "H8"],
    "M": ["M1", "M8"],
    "S": ["S1", "S8"],
    "f": ["f1", "f8", "f2"],
    "p": ["p1"],
    "zo": ["zo", "zg", "zo8"],
    "za": ["za", "za8"],
    "zn": ["zn"],
    "e": ["e1", "e2"],
}
_REPLACEMENT = _SEP.join("".join(f"${{{g}}}" for g in groups) for groups in _COMPONENTS.values())


def known_zones(spark: SparkSession | None = None) -> list[str]:
    """Zone names of the JVM that will evaluate them (else of the Python library)."""
    try:
        text = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString()
        return sorted(text.strip("[]").split(", "))
    except Exception:
        from zoneinfo import available_timezones

        return sorted(available_timezones())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 by integer arithmetic (years 1 to 9999)."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    mm = F.when(m > 2, m - 3).otherwise(m + 9)
    div = lambda a, b: F.floor(a / F.lit(float(b))).cast("long")
    return yy * 365 + div(yy, 4) - div(yy, 100) + div(yy, 400) + div(mm * 153 + 2, 5) + d - 1 - 719468


def _barrier(df: DataFrame, computed: list[str], dropped: list[str]) -> DataFrame:
    kept = [F.col(f"`{x}`") for x in df.columns if x not in computed and x not in dropped]
    return df.select(*kept, F.inline(F.array(F.struct(*[F.col(x) for x in computed]))))


def with_utc_micros(df: DataFrame, value: str, zone: str | None, out: str = "utc_us") -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC named by the string column ``value``,
    null where it names no instant. ``zone`` is the column with the IANA zone of
    values that carry none. Other columns are kept; working columns are dropped."""
    t = lambda name: f"__instant_{name}"
    names = list(_COMPONENTS)
    zones = known_zones(df.sparkSession)
    raw = F.split(F.regexp_replace(F.col(f"`{value}`"), F.lit(ALTERNATION), F.lit(_REPLACEMENT)), _SEP)
    df = df.withColumn(t("a"), raw)
    ok = F.size(t("a")) == len(names)
    text = lambda c: F.nullif(F.get(F.col(t("a")), F.lit(names.index(c))), F.lit(""))
    number = lambda c: text(c).try_cast("long")
    wall_zone = F.nullif(F.trim(F.col(f"`{zone}`")), F.lit("")) if zone else F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    place = F.position(F.lower(text("b")), F.lit("".join(MONTHS)))
    month = F.coalesce(number("m"), F.when(place % 3 == 1, F.floor((place + 2) / 3)))
    digits = F.regexp_replace(F.regexp_replace(text("zo"), r"^([+-])(\d)(?=:|$)", "$10$2"), "[+:-]", "")
    offset = F.when(text("zo").startswith("-"), -1).otherwise(1) * (
        F.substring(digits, 1, 2).try_cast("long") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("long"), F.lit(0))
    )
    df = df.withColumns({
        t("am"): F.try_element_at(table, F.upper(text("za"))).cast("long"),
        t("om"): F.when(text("zo").isNotNull(), offset),
    }).withColumns({
        t("y"): F.when(ok, number("y")),
        t("m"): month,
        t("d"): number("d"),
        t("j"): number("j"),
        t("hh"): number("H"),
        t("mi"): number("M"),
        t("ss"): F.coalesce(number("S"), F.lit(0)),
        t("f"): F.coalesce(F.rpad(F.substring(text("f"), 1, 6), 6, "0").try_cast("long"), F.lit(0)),
        t("p"): F.lower(text("p")),
        t("off"): F.coalesce(F.col(t("om")), F.col(t("am"))),
        t("bad"): (text("za").isNotNull() & F.col(t("am")).isNull()) | (F.abs(F.col(t("om"))) > 18 * 60) | (F.substring(digits, 3, 2).try_cast("long") > 59),
        t("z"): F.coalesce(text("zn"), wall_zone, F.lit("UTC")),
        t("e"): F.when(ok, F.rpad(text("e"), 19, "0")),
        t("ef"): F.length(text("e")) == 10,
    })
    c = lambda name: F.col(t(name))
    # A generator over one row ends the inlining of expressions: without it Catalyst
    # would substitute the components into every filter on the result.
    df = _barrier(df, [t(x) for x in ("y", "m", "d", "j", "hh", "mi", "ss", "f", "p", "off", "bad", "z", "e", "ef")], [t("a"), t("am"), t("om")])
    leap = ((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0)
    month_days = F.when(c("m") == 2, F.when(leap, 29).otherwise(28)).when(c("m").isin(4, 6, 9, 11), 30).otherwise(31)
    date_ok = F.when(c("j").isNotNull(), c("j").between(1, F.when(leap, 366).otherwise(365))).otherwise(c("m").between(1, 12) & c("d").between(1, month_days))
    hour_ok = F.when(c("p").isNotNull(), c("hh").between(1, 12)).otherwise(c("hh").between(0, 23))
    hour = F.when(c("p").isNull(), c("hh")).otherwise(c("hh") % 12 + F.when(c("p") == "p", 12).otherwise(0))
    valid = (c("y") >= 1) & date_ok & hour_ok & c("mi").between(0, 59) & c("ss").between(0, 59) & ~F.coalesce(c("bad"), F.lit(False))
    days = F.when(c("j").isNotNull(), days_from_civil(c("y"), F.lit(1), F.lit(1)) + c("j") - 1).otherwise(days_from_civil(c("y"), c("m"), c("d")))
    local = F.when(valid, ((days * 24 + hour) * 60 + c("mi")) * 60000000 + c("ss") * 1000000 + c("f"))
    df = df.withColumn(t("l"), local)
    # A zone the JVM doesn't know must not reach the conversion, which would fail.
    named = F.when(c("z").isin(zones), c("z")).otherwise(F.lit("UTC"))
    df = df.withColumns({t("n"): named, t("w"): F.timestamp_micros(c("l"))})
    df = df.withColumn(t("u"), F.to_utc_timestamp(c("w"), c("n")))
    in_zone = F.when((c("n") == c("z")) & (F.from_utc_timestamp(c("u"), c("n")) == c("w")), F.unix_micros(c("u")))
    # Bare digits: right-padded to nanoseconds, the last three digits cut off.
    epoch = F.substring(c("e"), 1, 16).try_cast("long") + F.when(c("ef"), c("f")).otherwise(0)
    result = F.when(c("e").isNotNull(), epoch).when(c("off").isNotNull(), c("l") - c("off") * 60000000).otherwise(in_zone)
    kept = [x for x in df.columns if not x.startswith("__instant_")]
    return df.select(*[F.col(f"`{x}`") for x in kept if x != out], F.explode(F.array(result)).alias(out))


def is_canonical(value: Column) -> Column:
    """Already of the form ``2025-01-31T08:05:09Z``."""
    return value.rlike(CANONICAL)
