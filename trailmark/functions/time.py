"""Dates and durations as Column expressions. The session's time zone has to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract

LOCAL_OFFSET = "-03:00"
OFFSET_HOURS = -3
#: Month names of date labels.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(extract(text, pattern).cast("double"), F.lit(0.0))


DURATION = r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"


def iso_duration_s(text: Column) -> Column:
    """P(nD)T(nH)(nM)(n.nS) in seconds; null for anything else."""
    s = _number(text, r"(\d+)D") * 86400 + _number(text, r"(\d+)H") * 3600 + _number(text, r"T(?:\d+H)?(\d+)M") * 60 + _number(text, r"(\d+(?:\.\d+)?)S")
    return F.when(text.rlike(DURATION), s)


def iso_duration_hours(text: Column) -> Column:
    """PT(nH)(nM)(nS), whole numbers only, in hours."""
    s = _number(text, r"(\d+)H") * 3600 + _number(text, r"(\d+)M") * 60 + _number(text, r"(\d+)S")
    return F.when(text.rlike(r"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?$"), s / 3600)


def fmt_duration(text: Column) -> Column:
    """3h30 or 45min; null if there are neither hours nor minutes."""
    fits = iso_duration_s(text).isNotNull() & ~text.contains("D")
    h, m = extract(text, r"(\d+)H").cast("int"), extract(text, r"(\d+)M").cast("int")
    long = F.format_string("%dh%02d", h, F.coalesce(m, F.lit(0)))
    return F.when(fits & (h > 0), long).when(fits & (h.isNotNull() | m.isNotNull()), F.format_string("%dmin", F.coalesce(m, F.lit(0))))


def write_duration(seconds: Column) -> Column:
    """PTnHnM, minutes rounded half to even."""
    minutes = F.bround(seconds / 60.0, 0).cast("long")
    return F.concat(F.lit("PT"), (minutes / 60).cast("long").cast("string"), F.lit("H"), (minutes % 60).cast("string"), F.lit("M"))


def clock_to_iso(text: Column) -> Column:
    """HH:MM or HH:MM:SS as a duration."""
    h, m, s = (F.coalesce(extract(text, p).cast("int"), F.lit(0)) for p in (r"^(\d+):", r"^\d+:(\d+)", r"^\d+:\d+:(\d+)"))
    return F.when(text.rlike(r"^\d+:\d{2}(:\d{2})?$"), F.concat(F.lit("PT"), h.cast("string"), F.lit("H"), m.cast("string"), F.lit("M"), F.when(s > 0, F.concat(s.cast("string"), F.lit("S"))).otherwise("")))


def fmt_hms(seconds: Column) -> Column:
    """1h 02m 03s or 2m 03s."""
    s = F.floor(seconds).cast("long")
    h, m = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long")
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).otherwise(F.format_string("%dm %02ds", m, s % 60))


def weekday_of(date_lex: Column) -> Column:
    """Of the date as written; Sunday is 0."""
    return F.dayofweek(F.try_to_date(F.substring(date_lex, 1, 10), "yyyy-MM-dd")) - 1


def instant(text: Column, naive_offset: str = LOCAL_OFFSET) -> Column:
    """A timestamp; text without an offset gets naive_offset; null if it can't be read."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    timed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.try_to_timestamp(F.when(zoned, timed).otherwise(F.concat(timed, F.lit(naive_offset))))


def parse_date_ms(text: Column) -> Column:
    return F.unix_millis(instant(text))


def exif_datetime(text: Column, offset: Column | None = None) -> Column:
    """YYYY:MM:DD HH:MM:SS and an offset, or the local one, in ISO form."""
    fits = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}")
    iso = F.regexp_replace(F.substring(text, 1, 19), r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3T")
    return F.when(fits, F.concat(iso, F.coalesce(offset, F.lit(LOCAL_OFFSET)) if offset is not None else F.lit(LOCAL_OFFSET)))


def sheet_date_ms(text: Column) -> Column:
    """Date(y,m,d,h,mi,s) with months from 0, at the local offset."""
    part = lambda k: F.coalesce(extract(text, r"Date\((\d+),(\d+),(\d+)(?:,(\d+),(\d+),(\d+))?\)", k).cast("int"), F.lit(0))
    written = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", part(1), part(2) + 1, part(3), part(4), part(5), part(6))
    return F.when(text.rlike(r"Date\(\d+,\d+,\d+"), parse_date_ms(written))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    v = degrees + minutes / 60.0 + seconds / 3600.0
    return F.bround(F.when(hemisphere.isin("S", "W"), -v).otherwise(v), 6)


def clock_or_number_s(text: Column) -> Column:
    """H:MM:SS or a leading number, in seconds."""
    part = lambda k: extract(text, r"^(\d+):(\d+):(\d+(?:\.\d+)?)", k).cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), extract(text, r"^\s*(\d+(?:\.\d+)?)").cast("double"))


def minute_round_local(epoch: Column) -> Column:
    """Seconds since the epoch to the local minute, from 30 s up, as written with the offset."""
    local = F.timestamp_seconds(F.floor((epoch + 30) / 60) * 60 + OFFSET_HOURS * 3600)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(LOCAL_OFFSET))


def tour_week(date: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", date).cast("date")


def date_label_pt(date: Column) -> Column:
    """16 de junho de 2026."""
    names = F.array(*map(F.lit, MONTHS))
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(" de "), F.element_at(names, F.month(date)), F.lit(" de "), F.year(date).cast("string"))
