"""Timestamp text: reading with an explicit offset, writing canonically."""

from pyspark.sql import Column, functions as F

_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def to_utc(text: Column) -> Column:
    """Timestamp of an ISO text that names its offset; null for naive or bad text."""

    return F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))


def canonical_ts(ts: Column) -> Column:
    """UTC text ending in Z, with six fraction digits only if the fraction is not zero."""

    utc = F.to_utc_timestamp(ts, F.current_timezone())
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != 0, F.date_format(utc, ".SSSSSS")).otherwise(""),
        F.lit("Z"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)
