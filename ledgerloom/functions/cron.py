"""Cron expressions of five or six fields (seconds first), in UTC, as columns.

A schedule is parsed to a struct of the allowed numbers of each field; days must fit day,
month and weekday alike. Ranges may wrap (``22-2``, ``FRI-MON``, ``DEC-FEB``). The day may be
``L`` (the month's last), ``L-3`` (three before it), ``15W`` (the working day nearest to it in its month)
or ``LW``; the weekday ``5L`` (the last one of the month) or ``MON#2`` (the second); these stand
alone in their field. ``?`` is ``*`` for day and weekday, and macros are whole expressions. All functions take
columns and work on whole tables of schedules; store what ``parse`` gives in a column of its own
first, as the others look at it many times. What does not parse is null, and ``problem`` says why.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields in order with their least and largest number, and the names of months and weekdays.
FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
MACROS = {
    "@EVERY_SECOND": "* * * * * *", "@EVERY_MINUTE": "0 * * * * *", "@HOURLY": "0 0 * * * *", "@DAILY": "0 0 0 * * *", "@MIDNIGHT": "0 0 0 * * *",
    "@WEEKLY": "0 0 0 * * 0", "@MONTHLY": "0 0 0 1 * *", "@YEARLY": "0 0 0 1 1 *", "@ANNUALLY": "0 0 0 1 1 *",
}
#: Days counted from the month's end or moved to a working day, and weekdays that are the last or the n-th of their month.
_DAY, _WEEKDAY = r"^(?:L(?:-([0-9]{1,2}))?(W)?|([0-9]{1,2})W)\z", r"^([0-7])(?:L|#([1-5]))\z"
#: The same marks as alternatives of a whole field, with numbers that there are.
_MARKS = {"day": r"|L(?:-(?:[0-2]?[0-9]|30))?W?|(?:0?[1-9]|[12][0-9]|3[01])W", "weekday": r"|[0-7](?:L|#[1-5])"}
#: A missed occurrence is not looked for over so many of them or more.
MOST_MISSED = 100_000
#: The calendar leaves at most 40 years between two days that fit a schedule (29 February on one weekday), if any fits.
FAR_YEARS = 41


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is found once, though it is looked at many times."""
    return F.transform(F.array(value), use)[0]


def _steps() -> str:
    """The pattern of the digits from 1 to the largest int."""
    most = str(2**31 - 1)
    less = [f"{most[:i]}[{'1' if i == 0 else '0'}-{chr(ord(d) - 1)}][0-9]{{{len(most) - 1 - i}}}" for i, d in enumerate(most) if d > ("1" if i == 0 else "0")]
    return f"0*(?:[1-9][0-9]{{0,{len(most) - 2}}}|{'|'.join(less)}|{most})"


def _pattern(name: str, low: int, high: int) -> str:
    """The texts that one field may be: parts between commas, or one mark."""
    number = f"0*(?:{'|'.join(map(str, range(high, low - 1, -1)))})"
    every = r"[*?]" if name in ("day", "weekday") else r"\*"
    part = f"(?:{every}|{number}(?:-{number})?)(?:/{_steps()})?"
    return rf"\A(?:{part}(?:,{part})*{_MARKS.get(name, '')})\z"


def _numbers(text: Column, low: int, high: int, name: str) -> Column:
    """The numbers that a well-formed field allows, ascending. A range whose end is before its beginning wraps."""
    size = 7 if name == "weekday" else high - low + 1

    def expand(part: Column) -> Column:
        body, step = F.split_part(part, F.lit("/"), F.lit(1)), F.split_part(part, F.lit("/"), F.lit(2))
        every, stepped, ranged = body.isin("*", "?"), F.contains(part, F.lit("/")), F.contains(body, F.lit("-"))
        first = F.when(every, low).otherwise(F.split_part(body, F.lit("-"), F.lit(1)).try_cast("int"))
        last = F.when(every | (stepped & ~ranged), high).when(ranged, F.split_part(body, F.lit("-"), F.lit(2)).try_cast("int")).otherwise(first)
        by = F.when(stepped, step.try_cast("int")).otherwise(1)
        return F.transform(F.sequence(first, F.when(first <= last, last).otherwise(last + size), by), lambda n: (n - low) % size + low)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ",", -1), expand))))


def _fields(expression: Column) -> Column:
    """The six fields in capitals, or fewer or more if it has not six (or five, without seconds)."""
    text = F.trim(F.upper(expression))
    named = F.when(F.startswith(text, F.lit("@")), F.create_map(*[F.lit(x) for pair in MACROS.items() for x in pair])[text])
    return _once(F.split(F.coalesce(named, text), r"\s+"), lambda parts: F.when(F.size(parts) == 5, F.concat(F.array(F.lit("0")), parts)).otherwise(parts))


def _named(parts: Column) -> Column:
    """The fields with numbers in place of the names of months and weekdays."""
    texts = []
    for i, (name, _, _) in enumerate(FIELDS):
        text = F.get(parts, F.lit(i))
        for n, word in [*enumerate(MONTHS, 1)] * (name == "month") + [*enumerate(WEEKDAYS)] * (name == "weekday"):
            text = F.replace(text, F.lit(word), F.lit(str(n)))
        texts.append(text)
    return F.array(*texts)


def _wrong(texts: Column) -> Column:
    """The first field that is malformed; null if none is."""
    reason = F
    for i, (name, low, high) in enumerate(FIELDS):
        reason = reason.when(~texts[i].rlike(_pattern(name, low, high)), name)
    return reason


def _parsed(texts: Column) -> list[tuple[str, Column]]:
    """Each field's allowed numbers by its name, with the marks of day and weekday, of well-formed fields."""
    found = []
    for i, (name, low, high) in enumerate(FIELDS):
        text = texts[i]
        numbers = _numbers(text, low, high, name)
        if name == "day":
            marked, offset = text.rlike(_DAY), F.regexp_extract(text, _DAY, 1).try_cast("int")
            from_end = F.when(F.startswith(text, F.lit("L")), F.coalesce(offset, F.lit(0)))
            numbers = F.when(marked, F.array(F.coalesce(F.regexp_extract(text, _DAY, 3).try_cast("int"), F.lit(0)))).otherwise(numbers)
            found += [("from_end", F.when(marked, from_end)), ("working", F.when(marked, F.endswith(text, F.lit("W"))).otherwise(False))]
        if name == "weekday":
            marked, nth = text.rlike(_WEEKDAY), F.regexp_extract(text, _WEEKDAY, 2).try_cast("int")
            numbers = F.when(marked, F.array(F.regexp_extract(text, _WEEKDAY, 1).try_cast("int"))).otherwise(numbers)
            numbers = F.array_sort(F.array_distinct(F.transform(numbers, lambda d: d % 7)))
            found.append(("nth", F.when(marked, F.coalesce(nth, F.lit(0)))))
        found.append((name, numbers))
    return found


def parse(expression: Column) -> Column:
    """``second, minute, hour, day, month, weekday`` as sorted arrays, with the marks of day and weekday; null for what is no schedule."""
    schedule = lambda texts: F.when(_wrong(texts).isNull(), F.struct(*[c.alias(name) for name, c in _parsed(texts)]))
    return _once(_fields(expression), lambda parts: F.when(F.size(parts) == 6, _once(_named(parts), schedule)))


def problem(expression: Column) -> Column:
    """Why an expression is no schedule: its number of fields, or the first field that is malformed; null if it is one."""
    return _once(_fields(expression), lambda parts: F.when(parts.isNull() | (F.size(parts) != 6), "fields").otherwise(_once(_named(parts), _wrong)))


def _wanted(schedule: Column, last: Column) -> Column:
    """The number of the one day that a marked field names, before it is moved, in the month that ends with ``last``."""
    return F.when(schedule["from_end"].isNotNull(), F.dayofmonth(last) - schedule["from_end"]).otherwise(schedule["day"][0])


def _working(wanted: Column, last: Column) -> Column:
    """The working day nearest to a day of the month that ends with ``last``; null if there is no such day."""
    target = F.date_add(F.trunc(last, "month"), wanted - 1)
    moved = F.when(F.dayofweek(target) == 7, F.when(wanted == 1, F.date_add(target, 2)).otherwise(F.date_sub(target, 1)))
    moved = moved.when(F.dayofweek(target) == 1, F.when(target == last, F.date_sub(target, 2)).otherwise(F.date_add(target, 1))).otherwise(target)
    return F.when((wanted >= 1) & (target <= last), moved)


def _week_fits(schedule: Column, day: Column) -> Column:
    nth = F.when(schedule["nth"].isNull(), True).when(schedule["nth"] == 0, F.date_add(day, 7) > F.last_day(day)).otherwise(F.ceil(F.dayofmonth(day) / 7) == schedule["nth"])
    return nth & F.array_contains(schedule["weekday"], F.dayofweek(day) - 1)


def day_fits(schedule: Column, day: Column) -> Column:
    number, last = F.dayofmonth(day), F.last_day(day)
    wanted = _wanted(schedule, last)
    moved = F.coalesce(_working(wanted, last) == day, F.lit(False))
    on_day = F.when(schedule["working"], moved).when(schedule["from_end"].isNotNull(), wanted == number).otherwise(F.array_contains(schedule["day"], number))
    return on_day & F.array_contains(schedule["month"], F.month(day)) & _week_fits(schedule, day)


def _days_in(schedule: Column, month: Column) -> Column:
    """The days that fit in a month, given by its first, of those that the day's field names."""
    last = F.last_day(month)
    wanted = _wanted(schedule, last)
    marked = F.when(schedule["working"], F.dayofmonth(_working(wanted, last))).when(schedule["from_end"].isNotNull(), wanted)
    numbers = F.when(schedule["working"] | schedule["from_end"].isNotNull(), F.array(marked)).otherwise(schedule["day"])
    days = F.transform(F.filter(numbers, lambda n: n.between(1, F.dayofmonth(last))), lambda n: F.date_add(month, n - 1))
    return F.filter(days, lambda d: _week_fits(schedule, d))


def _next_day(schedule: Column, today: Column) -> Column:
    """The first day after ``today`` that fits: of this month and the next, of the next year, of all years, in the months that fit."""
    begin = F.trunc(today, "month")

    def within(first: int, last: int) -> Column:
        months = F.filter(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.add_months(begin, i)), lambda m: F.array_contains(schedule["month"], F.month(m)))
        return F.array_min(F.filter(F.flatten(F.transform(months, lambda m: _days_in(schedule, m))), lambda d: d > today))

    return F.coalesce(within(0, 1), within(2, 13), within(14, 12 * FAR_YEARS))


def _clock(at: Column) -> tuple[Column, Column, Column]:
    return F.hour(at), F.minute(at), F.floor(F.second(at)).cast("int")


def _on(day: Column, seconds: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _end(schedule: Column, pick) -> Column:
    """The first or last time of a day that fits, in seconds."""
    return pick(schedule["hour"]) * 3600 + pick(schedule["minute"]) * 60 + pick(schedule["second"])


def _near(schedule: Column, at: Column, pick, beyond, here) -> Column:
    """The nearest time of the same day, in seconds: ``beyond`` the hour or minute, or with both and ``here``."""
    hour, minute, second = _clock(at)
    only = lambda name, test: pick(F.filter(schedule[name], test))
    in_hour = F.array_contains(schedule["hour"], hour)
    in_minute = in_hour & F.array_contains(schedule["minute"], minute)
    return F.coalesce(
        F.when(in_minute, hour * 3600 + minute * 60 + only("second", lambda x: here(x, second))),
        F.when(in_hour, hour * 3600 + only("minute", lambda x: beyond(x, minute)) * 60 + pick(schedule["second"])),
        only("hour", lambda x: beyond(x, hour)) * 3600 + pick(schedule["minute"]) * 60 + pick(schedule["second"]),
    )


def next_occurrence(schedule: Column, after: Column) -> Column:
    """The first occurrence strictly after a time; null if there is none at all.

    Days of this month and the next are looked at first; only schedules without one there look on.
    """
    today = F.to_date(after)
    above = lambda x, y: x > y
    near = F.when(day_fits(schedule, today), _near(schedule, after, F.array_min, above, above))
    return F.coalesce(_on(today, near), _on(_next_day(schedule, today), _end(schedule, F.array_min)))


def occurrences_on(schedule: Column, day: Column) -> Column:
    """All occurrences of one day, ascending; null on other days."""
    times = F.flatten(F.transform(schedule["hour"], lambda h: F.flatten(F.transform(schedule["minute"], lambda m: F.transform(schedule["second"], lambda s: h * 3600 + m * 60 + s)))))
    return F.when(day_fits(schedule, day), F.transform(times, lambda s: _on(day, s)))


def last_occurrence(schedule: Column, since: Column, until: Column) -> Column:
    """The last occurrence after ``since`` and not after ``until``; null if there is none."""
    today = F.to_date(until)
    near = F.when(day_fits(schedule, today), _near(schedule, until, F.array_max, lambda x, y: x < y, lambda x, y: x <= y))
    before = F.when(F.to_date(since) < today, F.array_max(F.filter(F.sequence(F.to_date(since), F.date_sub(today, 1)), lambda d: day_fits(schedule, d))))
    found = F.coalesce(_on(today, near), _on(before, _end(schedule, F.array_max)))
    return F.when(found > since, found)


def count_between(schedule: Column, since: Column, until: Column) -> Column:
    """Number of occurrences after ``since`` and not after ``until``."""
    size = lambda name: F.size(schedule[name]).cast("long")

    def up_to(at: Column) -> Column:
        hour, minute, second = _clock(at)
        below = lambda name, x: F.size(F.filter(schedule[name], lambda y: y < x))
        rest = below("minute", minute) * size("second") + F.when(F.array_contains(schedule["minute"], minute), F.size(F.filter(schedule["second"], lambda y: y <= second))).otherwise(0)
        return F.when(day_fits(schedule, F.to_date(at)), below("hour", hour) * size("minute") * size("second") + F.when(F.array_contains(schedule["hour"], hour), rest).otherwise(0)).otherwise(0)

    first, last = F.to_date(since), F.to_date(until)
    whole = F.when(first < last, F.size(F.filter(F.sequence(first, F.date_sub(last, 1)), lambda d: day_fits(schedule, d)))).otherwise(0)
    return whole * size("hour") * size("minute") * size("second") + up_to(until) - up_to(since)


def catch_up(schedule: Column, last_fired: Column, now: Column, window: Column) -> Column:
    """The latest missed occurrence, if it is at most ``window`` old.

    Null without a watermark or window, and where MOST_MISSED or more were missed: such
    a gap is not replayed.
    """
    missed = F.when(count_between(schedule, last_fired, now) < MOST_MISSED, last_occurrence(schedule, last_fired, now))
    return F.when(missed + window >= now, missed)
