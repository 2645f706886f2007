"""Next fire time of a cron schedule in its time zone, as column expressions.

Each schedule is one row and needs only its own fields, so there is nothing to
join: the matching days come first, then the matching minutes of the first few of
them, converted to UTC. A local time skipped by a clock change never fires; one that
occurs twice fires at both instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import let
from logweir.session import spread

# Names and shortcuts of the cron notation.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
SHORTCUTS = {
    "@hourly": "0 * * * *",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@weekly": "0 0 * * 0",
    "@monthly": "0 0 1 * *",
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
}
# Days to look ahead: enough for weekly, monthly and leap-day schedules in turn.
HORIZONS = [22, 100, 366 * 8 + 3]
FIELD = r"^(\*|\d+(-\d+)?)(/[1-9]\d*)?(,(\*|\d+(-\d+)?)(/[1-9]\d*)?)*$"


def _values(field: Column, low: int, high: int) -> Column:
    """All values a cron field allows, as an array."""

    def expand(part: Column) -> Column:
        def number(group: int) -> Column:
            return F.regexp_extract(part, r"^(?:\*|(\d+)(?:-(\d+))?)(?:/(\d+))?$", group)

        star = part.startswith("*")
        start = F.when(star, F.lit(low)).otherwise(number(1).cast("int"))
        end = (
            F.when(number(2) != "", number(2).try_cast("int"))
            .when(star | (number(3) != ""), F.lit(high))
            .otherwise(number(1).try_cast("int"))
        )
        step = F.coalesce(number(3).try_cast("int"), F.lit(1))
        return F.when((start >= low) & (end <= high) & (start <= end), F.sequence(start, end, step))

    def rename(text: Column, names: list[str], first: int) -> Column:
        for i, name in enumerate(names):
            text = F.replace(text, F.lit(name), F.lit(str(i + first)))
        return text

    text = F.lower(field)
    if high == 12:
        text = rename(text, MONTHS, 1)
    if high == 7:
        text = F.replace(rename(text, WEEKDAYS, 0), F.lit("?"), F.lit("*"))
    if high == 31:
        text = F.replace(text, F.lit("?"), F.lit("*"))
    parsed = F.flatten(F.transform(F.split(text, ","), expand))
    return F.when(text.rlike(FIELD), parsed)


def parse_cron(cron: Column) -> Column:
    """Fields of a five-field cron text as arrays; null if the text is not valid."""
    text = F.trim(F.regexp_replace(F.lower(cron), r"\s+", " "))
    known = F.create_map(*[F.lit(item) for pair in SHORTCUTS.items() for item in pair])

    def fields(parts: Column) -> Column:
        weekdays = F.transform(_values(parts[4], 0, 7), lambda day: day % 7)
        return F.when(
            F.size(parts) == 5,
            F.struct(
                _values(parts[0], 0, 59).alias("minutes"),
                _values(parts[1], 0, 23).alias("hours"),
                _values(parts[2], 1, 31).alias("days"),
                _values(parts[3], 1, 12).alias("months"),
                weekdays.alias("weekdays"),
                parts[2].rlike(r"^[*?](/1)?$").alias("any_day"),
                parts[4].rlike(r"^[*?](/1)?$").alias("any_weekday"),
            ),
        )

    return let(let(text, lambda given: F.split(F.coalesce(F.try_element_at(known, given), given), " ")), fields)


def is_valid_cron(cron: Column) -> Column:
    def complete(fields: Column) -> Column:
        filled = fields.isNotNull()
        for name in ("minutes", "hours", "days", "months", "weekdays"):
            filled = filled & fields[name].isNotNull()
        return F.coalesce(filled, F.lit(False))

    return let(parse_cron(cron), complete)


def next_fire(schedules: DataFrame, cron: str, timezone: str, after: str, result: str = "next_fire_at") -> DataFrame:
    """Add the first instant after ``after`` at which the schedule fires (UTC).

    Away from clock changes the answer is plain arithmetic on local time; only rows
    near one look at the candidates of whole days.
    """
    zone = F.when(F.coalesce(F.col(timezone), F.lit("")) == "", "UTC").otherwise(F.col(timezone))
    staged = (
        spread(schedules).withColumn("_fields", parse_cron(F.col(cron)))
        .withColumn("_zone", zone)
        .withColumn("_after", F.col(after).cast("timestamp"))
        .withColumn("_local", F.from_utc_timestamp("_after", F.col("_zone")))
    )
    fields, today = F.col("_fields"), F.to_date("_local")
    now_minute = F.hour("_local") * 60 + F.minute("_local")

    def day_matches(day: Column) -> Column:
        by_day = F.array_contains(fields["days"], F.dayofmonth(day))
        by_weekday = F.array_contains(fields["weekdays"], F.dayofweek(day) - 1)
        either = F.when(fields["any_day"] | fields["any_weekday"], by_day & by_weekday).otherwise(by_day | by_weekday)
        return F.array_contains(fields["months"], F.month(day)) & either

    def days(horizon: int) -> Column:
        return F.filter(F.sequence(today, F.date_add(today, horizon - 1)), day_matches)

    # Three days: one may be over already, and a clock change may skip the next one.
    staged = staged.withColumn("_days", days(HORIZONS[0]))
    for horizon in HORIZONS[1:]:
        staged = staged.withColumn("_days", F.when(F.size("_days") >= 3, F.slice("_days", 1, 3)).otherwise(days(horizon)))
    minutes = F.flatten(F.transform(fields["hours"], lambda hour: F.transform(fields["minutes"], lambda minute: hour * 60 + minute)))
    staged = staged.withColumn("_minutes", minutes)

    def to_time(day: Column, minute: Column) -> Column:
        return F.timestamp_add("MINUTE", minute, day.cast("timestamp"))

    def to_utc(local: Column) -> Column:
        return F.to_utc_timestamp(local, F.col("_zone"))

    def to_local(utc: Column) -> Column:
        return F.from_utc_timestamp(utc, F.col("_zone"))

    later_today = F.array_min(F.filter("_minutes", lambda minute: minute > now_minute))
    first_day = F.get("_days", 0)
    is_today = first_day == today
    other_day = F.when(is_today, F.get("_days", 1)).otherwise(first_day)
    plain = F.when(is_today & later_today.isNotNull(), to_time(first_day, later_today)).otherwise(
        to_time(other_day, F.array_min("_minutes"))
    )
    staged = staged.withColumn("_plain", plain).withColumn("_fires", to_utc(F.col("_plain")))
    two_hours = F.expr("INTERVAL '2' HOUR")
    steady = (
        (to_local(F.col("_fires")) == F.col("_plain"))
        & (F.col("_fires") > F.col("_after"))
        & (to_local(F.col("_after") + two_hours) == F.col("_local") + two_hours)
    )

    def first_instant(day: Column) -> Column:
        """First firing instant after ``after`` on a local day, clock changes and all."""

        def at(minute: Column) -> Column:
            local = to_time(day, minute)
            shifts = F.array(F.lit(0), F.lit(30), F.lit(60))
            instants = F.transform(shifts, lambda shift: F.timestamp_add("MINUTE", shift, to_utc(local)))
            return F.array_min(F.filter(instants, lambda utc: (to_local(utc) == local) & (utc > F.col("_after"))))

        return F.array_min(F.transform("_minutes", at))

    exact = F.array_min(F.transform("_days", first_instant))
    answer = F.when(steady, F.col("_fires")).otherwise(exact)
    helpers = ["_fields", "_zone", "_after", "_local", "_days", "_minutes", "_plain", "_fires"]
    return staged.withColumn(result, answer).drop(*helpers)
