"""Wall time to UTC, calendar columns and public holidays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.lookups import OPERATORS, STATE_OPERATOR, lookup


def wall_to_utc(local: Column, tz: str = "Europe/Berlin") -> Column:
    """Local timestamp to UTC: the earlier instant in the autumn hour, +1 h in the spring gap."""
    return F.to_utc_timestamp(local, tz)


def parse_wall_time(
    date: Column, time: Column, tz: str = "Europe/Berlin", ignore_pm: bool = False
) -> Column:
    """``dd.MM.yyyy`` and ``H:mm`` with ``A``/``B`` markers of the doubled autumn hour.

    A ``B`` marks the second pass through the hour. Times with AM/PM are read on
    the 12-hour clock; ``ignore_pm`` keeps the hour as written instead.
    """
    raw = F.upper(F.trim(time))
    half_day = raw.rlike("(AM|PM)")
    second = raw.contains("B")
    clock = F.regexp_replace(F.regexp_replace(raw, "(AM|PM)$", ""), "[AB]", "")
    clock = F.regexp_replace(F.trim(clock), "\\s+", " ")
    local = F.try_to_timestamp(F.concat(date, F.lit(" "), clock), F.lit("dd.MM.yyyy H:mm"))
    if not ignore_pm:
        hour = F.hour(local)
        shift = (
            F.when(half_day & raw.endswith("PM") & (hour < 12), F.lit(12))
            .when(half_day & raw.endswith("AM") & (hour == 12), F.lit(-12))
            .otherwise(F.lit(0))
        )
        local = local + F.make_dt_interval(F.lit(0), shift)
    first = F.to_utc_timestamp(local, tz)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(second & (F.from_utc_timestamp(later, tz) == local), later).otherwise(first)


def parse_interval_columns(
    df: DataFrame, tz: str = "Europe/Berlin", ignore_pm: bool = False
) -> DataFrame:
    return df.withColumn(
        "begin_date", parse_wall_time(F.col("begin_date"), F.col("begin_time"), tz, ignore_pm)
    ).withColumn(
        "end_date", parse_wall_time(F.col("end_date"), F.col("end_time"), tz, ignore_pm)
    )


def easter_sunday(year: Column) -> Column:
    """Date of Easter by the Gregorian computus."""
    y = year.cast("int")
    century = F.floor(y / 100).cast("int")
    golden = F.pmod(y, F.lit(19))
    skipped = century - F.floor(century / 4).cast("int")
    moon = F.floor((century * 8 + 13) / 25).cast("int")
    epact = F.pmod(skipped - moon + golden * 19 + 15, F.lit(30))
    late = F.when(
        (epact == 29) | ((epact == 28) & (golden > 10)), F.lit(1)
    ).otherwise(F.lit(0))
    full_moon = epact - late
    weekday = F.pmod(
        y + F.floor(y / 4).cast("int") + full_moon + 2 - skipped, F.lit(7)
    )
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), full_moon - weekday)


# Holidays by month and day, and by days from Easter; states that
# keep them ("*" = all).
FIXED_HOLIDAYS = [
    (1, 1, "*"),
    (1, 6, "Baden-Württemberg,Bayern,Sachsen-Anhalt"),
    (5, 1, "*"),
    (8, 15, "Bayern,Saarland"),
    (10, 3, "*"),
    (10, 31, "Brandenburg,Bremen,Hamburg,Mecklenburg-Vorpommern,Niedersachsen,"
             "Sachsen,Sachsen-Anhalt,Schleswig-Holstein,Thüringen"),
    (11, 1, "Baden-Württemberg,Bayern,Nordrhein-Westfalen,Rheinland-Pfalz,Saarland"),
    (11, 20, "Sachsen"),
    (12, 25, "*"),
    (12, 26, "*"),
]
EASTER_HOLIDAYS = [
    (-2, "*"),
    (1, "*"),
    (39, "*"),
    (50, "*"),
    (60, "Baden-Württemberg,Bayern,Hessen,Nordrhein-Westfalen,Rheinland-Pfalz,Saarland"),
]


def holiday_rules() -> Column:
    rules = [
        F.struct(
            F.lit(m).alias("month"), F.lit(d).alias("dom"),
            F.lit(None).cast("int").alias("offset"), F.lit(s).alias("states"),
        )
        for m, d, s in FIXED_HOLIDAYS
    ] + [
        F.struct(
            F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("dom"),
            F.lit(o).alias("offset"), F.lit(s).alias("states"),
        )
        for o, s in EASTER_HOLIDAYS
    ]
    return F.array(*rules)


def holidays_of_years(years: DataFrame, year: str = "year") -> DataFrame:
    """(day, operator, is_holiday = 1) for each year: an operator rests if one of its states does."""
    days = years.select(F.col(year), F.explode(holiday_rules()).alias("r")).select(
        F.coalesce(
            F.make_date(F.col(year), F.col("r.month"), F.col("r.dom")),
            F.date_add(easter_sunday(F.col(year)), F.col("r.offset")),
        ).alias("day"),
        F.col("r.states").alias("states"),
    )
    everyone = F.array(*[F.lit(o) for o in OPERATORS])
    some = F.transform(F.split("states", ","), lambda s: lookup(s, STATE_OPERATOR))
    return (
        days.select(
            "day",
            F.explode(F.when(F.col("states") == "*", everyone).otherwise(some)).alias("operator"),
        )
        .distinct()
        .withColumn("is_holiday", F.lit(1))
    )


def holiday_calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    return holidays_of_years(spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")))


def add_calendar(
    df: DataFrame, at: Column, holidays: DataFrame | None = None, operator: str = "operator"
) -> DataFrame:
    """Calendar columns of the instant ``at``; holidays join on (date, operator)."""
    out = (
        df.withColumn("_at", at)
        .withColumn("hour", F.hour("_at"))
        .withColumn("day", F.dayofmonth("_at"))
        .withColumn("month", F.month("_at"))
        .withColumn("is_weekend", (F.weekday("_at") >= 5).cast("int"))
    )
    if holidays is None:
        out = out.withColumn("is_holiday", F.lit(0))
    else:
        h = holidays.select(
            F.col("day").alias("_hd"), F.col("operator").alias("_ho"),
            F.col("is_holiday").alias("_hf"),
        )
        out = (
            out.join(
                h,
                (F.to_date("_at") == F.col("_hd")) & (F.col(operator) == F.col("_ho")),
                "left",
            )
            .withColumn("is_holiday", F.coalesce(F.col("_hf"), F.lit(0)).cast("int"))
            .drop("_hd", "_ho", "_hf")
        )
    workday = (F.weekday("_at") < 5) & (F.col("is_holiday") == 0)
    return out.withColumn("is_workday", workday.cast("int")).drop("_at")
