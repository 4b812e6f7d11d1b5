"""Time texts of mixed formats and zones to one instant.

All accepted spellings are compiled into one alternation with named groups. A text
goes through it once: the replacement writes the components in a fixed order, so
the JVM does a single regex pass per text and nothing else parses the string. The
components are checked against calendar ranges and assembled by integer day
arithmetic. Wall clocks get the offset of their zone; a wall clock that its zone
showed never (clocks put forward) or twice (clocks put back) names no instant.

Defined results: null, empty, blank or unreadable text parses to null; seconds of
60 or dates outside the calendar are unreadable; an unusable zone name gives no
instant; digits after the second are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components in the order in which the replacement writes them.
PARTS = ("y", "m", "d", "h", "i", "s", "p", "z", "e", "k")

_TIME = r"(?<h>\d{2}):(?<i>\d{2}):(?<s>\d{2})(?:[.,]\d{1,9})?"
_ZONE = r"(?: ?(?<z>[Zz]|(?:UTC|GMT|utc|gmt)?[+-]\d{2}(?::?\d{2})?|UTC|GMT|utc|gmt))?"
_MONTH = r"(?<m>[A-Za-z]{3,9})\.?"

#: Accepted spellings: y year, m month, d day, h hour, i minute, s second, p half of
#: the day, z zone, e seconds and k milliseconds since 1970.
SPELLINGS = (
    r"(?<y>\d{4})(?:-(?<m>\d{2})-|:(?<m>\d{2}):|/(?<m>\d{2})/)(?<d>\d{2})[T ]" + _TIME + _ZONE,
    r"(?<y>\d{4})(?<m>\d{2})(?<d>\d{2})[T_\- ]?(?<h>\d{2})(?<i>\d{2})(?<s>\d{2})(?:[.,]\d{1,9})?" + _ZONE,
    r"(?:[A-Za-z]{3,9},? )?(?<d>\d{1,2})[ \-]" + _MONTH + r"[ \-](?<y>\d{4}),? " + _TIME + _ZONE,
    r"(?<d>\d{1,2}) " + _MONTH + r" (?<y>\d{4}),? (?<h>\d{1,2}):(?<i>\d{2}):(?<s>\d{2})\h?(?<p>[AaPp])\.?[Mm]\.?",
    _MONTH + r" (?<d>\d{1,2}), (?<y>\d{4}),? (?<h>\d{1,2}):(?<i>\d{2}):(?<s>\d{2})\h?(?<p>[AaPp])\.?[Mm]\.?",
    r"(?<e>-?\d{9,10})(?:\.\d{1,9})?",
    r"(?<k>-?\d{12,13})",
)


def _compile(spellings: tuple[str, ...]) -> tuple[str, str]:
    """The alternation, and the replacement that writes every component once."""
    groups: dict[str, list[str]] = {part: [] for part in PARTS}
    alternatives = []
    for number, spelling in enumerate(spellings):
        pieces = spelling.split("(?<")
        text = pieces[0]
        for position, piece in enumerate(pieces[1:]):
            part, _, rest = piece.partition(">")
            name = f"{part}{number}x{position}"
            groups[part].append(name)
            text += f"(?<{name}>{rest}"
        alternatives.append(text)
    replacement = "\u0001" + "|".join("".join("${%s}" % name for name in groups[part]) for part in PARTS)
    return r"^\s*(?:" + "|".join(alternatives) + r")\s*$", replacement


_PATTERN, _REPLACEMENT = _compile(SPELLINGS)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def components(text: Column) -> Column:
    """Array of the components of PARTS (absent ones empty), null if unreadable."""
    once = F.regexp_replace(text, _PATTERN, _REPLACEMENT)
    return F.when(once.startswith("\u0001"), F.split(F.substring(once, 2, 200), r"\|", -1))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    shifted = F.when(m > 2, y).otherwise(y - 1)
    month = F.when(m > 2, m - 3).otherwise(m + 9)
    leap = F.floor(shifted / 4) - F.floor(shifted / 100) + F.floor(shifted / 400)
    return shifted * 365 + leap + F.floor((month * 153 + 2) / 5) + d - 719469


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often it is used.

    The lambda keeps the optimizer from copying ``value`` into each of its uses.
    """
    return F.transform(F.array(value), body)[0]


def parsed(text: Column, wall_only: bool = False) -> Column:
    """struct(secs, fixed) of a time text; null if it is no date and time.

    secs: seconds since 1970, of the instant if ``fixed`` (the text has its own zone
    or counts from 1970), else of the wall clock. With ``wall_only`` the written zone
    is left aside, and counts from 1970, which show no clock, give null.
    """

    def numbers(parts: Column) -> Column:
        part = {p: parts[n] for n, p in enumerate(PARTS)}
        word = F.position(F.lower(F.substring(part["m"], 1, 3)), F.lit(_MONTHS))
        month = F.coalesce(part["m"].try_cast("bigint"), F.when(word % 3 == 1, F.floor((word + 2) / 3)))
        hour = part["h"].try_cast("bigint")
        twelve = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part["p"]) == "p", 12).otherwise(0))
        count = F.when(part["e"] != "", part["e"].try_cast("bigint")).otherwise(
            F.floor(part["k"].try_cast("bigint") / 1000)
        )
        return F.struct(
            *(part[p].try_cast("bigint").alias(p) for p in "ydis"),
            month.alias("m"),
            F.when(part["p"] == "", hour).otherwise(twelve).alias("h"),
            part["z"].alias("z"),
            (F.lit(None).cast("bigint") if wall_only else count).alias("count"),
        )

    def shown(n: Column) -> Column:
        in_range = (
            n["y"].between(1, 9999)
            & n["m"].between(1, 12)
            & n["d"].between(F.lit(1), _month_length(n["y"], n["m"]))
            & n["h"].between(0, 23)
            & n["i"].between(0, 59)
            & n["s"].between(0, 59)
        )
        wall = days_from_civil(n["y"], n["m"], n["d"]) * 86400 + n["h"] * 3600 + n["i"] * 60 + n["s"]
        return F.struct(
            n["count"].alias("count"),
            F.when(in_range, wall.cast("bigint")).alias("wall"),
            (F.lit(True) if wall_only else n["z"] == "").alias("plain"),
            (F.lit(None).cast("bigint") if wall_only else zone_offset(n["z"])).alias("offset"),
        )

    def result(w: Column) -> Column:
        secs = F.coalesce(w["count"], F.when(w["plain"], w["wall"]).otherwise(w["wall"] - w["offset"]))
        fixed = w["count"].isNotNull() | ~w["plain"]
        return F.when(secs.isNotNull(), F.struct(secs.alias("secs"), fixed.alias("fixed")))

    return let(let(let(components(text), numbers), shown), result)


def zone_offset(text: Column) -> Column:
    """Seconds east of a written offset (Z, UTC, +02, -0530, GMT+01:00), else null."""
    pattern = r"^(?:(?:utc|gmt)?([+-])(\d{1,2})(?::?(\d{2}))?|z|utc|gmt)$"

    def seconds(parts: Column) -> Column:
        hours = F.coalesce(parts[1].try_cast("bigint"), F.lit(0))
        minutes = F.coalesce(parts[2].try_cast("bigint"), F.lit(0))
        size = hours * 3600 + minutes * 60
        return F.when(parts.isNotNull() & (hours <= 14) & (minutes <= 59), F.when(parts[0] == "-", -size).otherwise(size))

    def split(low: Column) -> Column:
        return F.when(low.rlike(pattern), F.split(F.regexp_replace(low, pattern, "$1|$2|$3"), r"\|", -1))

    return let(let(F.lower(F.trim(text)), split), seconds)


def zone_names(spark: SparkSession) -> DataFrame:
    """zone_key, zone: every zone name that the JVM knows, by its folded spelling.

    Bounded by the time zone database (about 600 names), hence safe to broadcast.
    """
    names = sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    folded: dict[str, str] = {}
    for name in names:
        folded.setdefault(name.lower(), name)
    return spark.createDataFrame(sorted(folded.items()), "zone_key string, zone string")


def _offset_at(utc: Column, zone: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc), zone)) - utc


def wall_to_utc(wall: Column, zone: Column) -> Column:
    """The instant at which the clock of ``zone`` showed ``wall``; null if never or twice.

    The offsets in force well before and well after are the only candidates, as no
    zone changes twice within the 30 hours between them; the instant counts if
    exactly one of them shows that wall clock.
    """

    def candidates(_: Column) -> Column:
        return F.array_distinct(
            F.array(wall - _offset_at(wall - 15 * 3600, zone), wall - _offset_at(wall + 15 * 3600, zone))
        )

    def single(instants: Column) -> Column:
        return F.when(F.size(instants) == 1, instants[0])

    fitting = F.filter(let(wall, candidates), lambda u: u + _offset_at(u, zone) == wall)
    return let(fitting, single)


def resolve_instants(df: DataFrame, parsed_name: str, zone_text: str, out: str) -> DataFrame:
    """Adds ``out``, the instant in seconds of the parsed struct, and keeps rows that have one."""
    names = zone_names(df.sparkSession).withColumnsRenamed({"zone_key": "__zone_key", "zone": "__zone"})
    at, fixed = F.col(parsed_name)["secs"], F.col(parsed_name)["fixed"]
    named = df.withColumn("__zone_key", F.lower(F.translate(F.trim(F.col(zone_text)), " ", "_")))
    named = named.join(F.broadcast(names), "__zone_key", "left")
    wall = F.when(
        F.col("__zone").isNotNull(), wall_to_utc(at, F.col("__zone"))
    ).otherwise(at - zone_offset(F.col(zone_text)))
    return (
        named.withColumn(out, F.when(fixed, at).otherwise(wall))
        .where(F.col(out).isNotNull())
        .drop("__zone_key", "__zone")
    )


def normalise_candidates(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """candidate_id, utc_second: the one instant of each date candidate.

    The first readable text of ``date_time_original``, ``local_date_time`` and the
    ``taken_at`` of the named asset decides; candidates without a readable text, or
    whose text names no single instant, have no row. Repeated rows count once.
    Assets are read only for candidates that have no readable text of their own.
    """
    own = candidates.select(
        "candidate_id",
        "asset_id",
        "tz_name",
        F.coalesce(parsed(F.col("date_time_original")), parsed(F.col("local_date_time"))).alias("__parsed"),
    )
    direct = own.where(F.col("__parsed").isNotNull()).select("candidate_id", "tz_name", "__parsed")
    lacking = own.where(F.col("__parsed").isNull() & F.col("asset_id").isNotNull()).select(
        "candidate_id", "asset_id", "tz_name"
    )
    ledger = assets.where(F.col("taken_at").isNotNull()).select(F.col("id").alias("asset_id"), "taken_at")
    borrowed = (
        lacking.join(ledger, "asset_id")
        .select("candidate_id", "tz_name", parsed(F.col("taken_at")).alias("__parsed"))
        .where(F.col("__parsed").isNotNull())
    )
    whole = direct.unionByName(borrowed)
    return resolve_instants(whole, "__parsed", "tz_name", "utc_second").select("candidate_id", "utc_second").distinct()
