"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone (session zone UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def at_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def bin_start(ts: Column, seconds: int) -> Column:
    """Start of the bin of fixed length that a timestamp lies in."""
    return at_epoch(F.floor(epoch(ts) / seconds) * seconds)


def local_time(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def utc_time(local: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def suspect(x: Column, most: float) -> Column:
    """True where a measured value is 0 or above a limit; null stays null."""
    return (x == 0) | (x > most)


def trusted(x: Column, most: float) -> Column:
    """x as a double, null where it is suspect."""
    return F.when(~suspect(x, most), x.cast("double"))


def ordered_mean(key: Column, x: Column) -> Column:
    """Mean of the non-null x of a group, added up in the order of key: the same bits however rows are spread.

    Groups here are one time's sites: a handful of values, bounded by the dimension.
    """
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(key.alias("k"), x.alias("x")))))
    return F.when(F.size(rows) > 0, F.aggregate(F.transform(rows, lambda r: r.x), F.lit(0.0), lambda a, v: a + v) / F.size(rows))


def wind_power(v: Column, cut_in: float, rated: float, cut_out: float) -> Column:
    """Share of rated power at a wind speed: cubic from cut-in to rated, 0 outside, null for null."""
    cubic = (F.pow(v, F.lit(3.0)) - cut_in**3) / (rated**3 - cut_in**3)
    return F.when((v < cut_in) | (v >= cut_out), 0.0).when(v >= rated, 1.0).otherwise(cubic)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def cut_points(x: Column, points: list[float], labels: list[str]) -> Column:
    """Label of the left-closed interval that x lies in; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(points, points[1:], labels))):
        out = F.when((x >= lo) & (x < hi), F.lit(label)).otherwise(out)
    return out


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def easter(year: int) -> date:
    """Gregorian Easter Sunday (Meeus, Jones and Butcher)."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _monday(year: int, month: int, last: bool = False) -> date:
    if last:
        d = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
        return d - timedelta(days=d.weekday())
    d = date(year, month, 1)
    return d + timedelta(days=-d.weekday() % 7)


def bank_holidays(first: int, last: int) -> list[tuple[date, str, str]]:
    """(date, region, name) of bank holidays in England (ENG) and Scotland (SCT) for the years first..last.

    Days on a weekend move to the next working day that isn't one itself; moved and single days are fixed values.
    """
    single = {  # fixed values: days proclaimed once, and May days moved for them
        date(1999, 12, 31): "Millennium", date(2002, 6, 3): "Golden Jubilee", date(2011, 4, 29): "Royal wedding", date(2012, 6, 5): "Diamond Jubilee",
        date(2022, 6, 3): "Platinum Jubilee", date(2022, 9, 19): "State funeral", date(2023, 5, 8): "Coronation",
    }
    early_may = {1995: date(1995, 5, 8), 2020: date(2020, 5, 8)}
    spring = {2002: date(2002, 6, 4), 2012: date(2012, 6, 4), 2022: date(2022, 6, 2)}
    out = []
    for y in range(first, last + 1):
        for region in ("ENG", "SCT"):
            taken: set[date] = set()

            def put(d: date, name: str, region=region, taken=taken) -> None:
                while d.weekday() > 4 or d in taken:
                    d += timedelta(days=1)
                taken.add(d)
                out.append((d, region, name))

            good = easter(y) - timedelta(days=2)
            put(date(y, 1, 1), "New Year's Day")
            if region == "SCT":
                put(date(y, 1, 2), "2 January")
            put(good, "Good Friday")
            if region == "ENG":
                put(good + timedelta(days=3), "Easter Monday")
            put(early_may.get(y, _monday(y, 5)), "Early May")
            put(spring.get(y, _monday(y, 5, last=True)), "Spring")
            put(_monday(y, 8, last=region == "ENG"), "Summer")
            if region == "SCT" and y >= 2007:
                put(date(y, 11, 30), "St Andrew's Day")
            put(date(y, 12, 25), "Christmas Day")
            put(date(y, 12, 26), "Boxing Day")
            for d, name in single.items():
                if d.year == y:
                    put(d, name)
    return sorted(out)
