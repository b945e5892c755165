"""Period labels and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("month", "season", "semester", "year")

#: The months of tide-gauge year fractions, trailing zeros cut.
GAUGE_MONTHS = {
    "0417": 1,
    "125": 2,
    "2083": 3,
    "2917": 4,
    "375": 5,
    "4583": 6,
    "5417": 7,
    "625": 8,
    "7083": 9,
    "7917": 10,
    "875": 11,
    "9583": 12,
}


def period_label(day: Column, granularity: str) -> Column:
    """``YYYY-MM``, ``YYYY-DJF|MAM|JJA|SON`` (December counts to the next year), ``YYYY-S1|S2`` or ``YYYY``."""
    y, m = F.year(day), F.month(day)
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    if granularity == "year":
        return y.cast("string")
    if granularity == "semester":
        return F.concat(y.cast("string"), F.when(m <= 6, F.lit("-S1")).otherwise(F.lit("-S2")))
    if granularity == "season":
        name = F.when(m.isin(12, 1, 2), "-DJF").when(m <= 5, "-MAM").when(m <= 8, "-JJA").otherwise("-SON")
        return F.concat((y + F.when(m == 12, 1).otherwise(0)).cast("string"), name)
    raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}, not {granularity!r}")


def label_date(label: Column) -> Column:
    """First day of a labelled period (a DJF label stands for 1 January); an unknown label raises."""
    year = F.substring(label, 1, 4).cast("int")
    tail = F.substring(label, 6, 3)
    month = (
        F.when(label.rlike(r"^\d{4}$"), F.lit(1))
        .when(label.rlike(r"^\d{4}-\d{2}$"), F.try_to_number(F.substring(label, 6, 2), F.lit("99")).cast("int"))
        .when(label.rlike(r"^\d{4}-S[12]$"), F.when(tail == "S1", 1).otherwise(7))
        .when(label.rlike(r"^\d{4}-(DJF|MAM|JJA|SON)$"), F.when(tail == "DJF", 1).when(tail == "MAM", 3).when(tail == "JJA", 6).otherwise(9))
    )
    return F.when(month.isNull() & label.isNotNull(), F.raise_error(F.concat(F.lit("unrecognised period label: "), label)).cast("date")).otherwise(F.make_date(year, month, F.lit(1)))


def label_granularity(label: Column) -> Column:
    return (
        F.when(label.rlike(r"^\d{4}$"), "Annual").when(label.rlike(r"^\d{4}-S[12]$"), "Semester").when(label.rlike("(DJF|MAM|JJA|SON)$"), "Seasonal").otherwise("Monthly")
    )


def gauge_month(text: Column) -> Column:
    """Month of a decimal tide-gauge date kept as text; no fraction means January, an unknown one NULL."""
    text = F.trim(text)
    fraction = F.regexp_replace(F.regexp_extract(text, r"^\d{4}\.(\d+)$", 1), "0+$", "")
    months = F.create_map(*[F.lit(x) for pair in GAUGE_MONTHS.items() for x in pair])
    month = F.when(fraction == "", F.lit(1)).otherwise(F.element_at(months, fraction))
    year = F.regexp_extract(text, r"^(\d{4})(\.\d*)?$", 1)
    return F.when(year != "", F.make_date(F.nullif(year, F.lit("")).cast("int"), month, F.lit(1)))


def cf_time(offset: Column, unit: str, origin: str) -> Column:
    """Timestamp of a CF time value counted in hours or days from the origin."""
    seconds = {"hours": 3600, "days": 86400}.get(unit)
    if seconds is None:
        raise ValueError(f"unsupported time unit: {unit!r}")
    return F.timestamp_add("SECOND", F.round(offset * seconds).cast("long"), F.lit(origin).cast("timestamp_ntz"))
