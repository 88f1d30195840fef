"""Column helpers: recodes, patches, clamps, text, time and rounding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- recodes ---------------------------------------------------------------

def recode(c: Column | str, mapping: Mapping, default: Column | str | None = None) -> Column:
    """Replace known codes; unknown ones stay, or become ``default`` if given."""
    c = as_column(c)
    other = c if default is None else (F.lit(default) if isinstance(default, str) else default)
    if not mapping:
        return other
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), other)


def ladder(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str | None) -> Column:
    """First label whose bound exceeds the value; NULL in gives NULL out."""
    c = as_column(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(c < F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def patch_value(key: Column | str, value: Column | str, patches: Mapping) -> Column:
    """Override ``value`` on the few listed keys."""
    value = as_column(value)
    key = as_column(key)
    out = None
    for k, v in patches.items():
        hit = key == F.lit(k)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return value if out is None else out.otherwise(value)


def ordinal(c: Column | str, levels: Sequence) -> Column:
    """1-based position in the level list; NULL for an unknown level."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for i, lv in enumerate(levels, 1) for x in (lv, i)]), as_column(c))


def clamp_zero(c: Column | str) -> Column:
    """Negatives become 0 and NULL stays NULL (``greatest`` would not)."""
    c = as_column(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def celsius(c: Column | str, above: float = 50.0) -> Column:
    """Readings above the plausible range are taken as Fahrenheit."""
    c = as_column(c)
    return F.when(c > above, (c - 32.0) * 5.0 / 9.0).otherwise(c)


# --- text ------------------------------------------------------------------

def unite(cols: Iterable[Column | str], sep: str = "_", skip_null: bool = False) -> Column:
    """Join columns into one key; a NULL prints as ``NA`` unless skipped."""
    parts = [as_column(c).cast("string") for c in cols]
    if not skip_null:
        parts = [F.coalesce(p, F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *parts)


def separate(c: Column | str, sep: str, into: Sequence[str | None]) -> dict[str, Column]:
    """Named parts of a text split at a literal separator.

    ``None`` drops that slot, surplus parts vanish, missing ones are NULL.
    """
    literal = "".join("\\" + ch if not ch.isalnum() and ch != "_" and ch != " " else ch for ch in sep)
    parts = F.split(as_column(c), literal)
    return {name: F.try_element_at(parts, F.lit(i)) for i, name in enumerate(into, 1) if name}


def strip_suffix(c: Column | str, suffix: str) -> Column:
    c = as_column(c)
    kept = c.substr(F.lit(1), F.length(c) - F.lit(len(suffix)))
    return F.when(c.endswith(suffix), kept).otherwise(c)


def basename(c: Column | str) -> Column:
    return F.substring_index(as_column(c), "/", -1)


def dash_if_null(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit("-"))


def scientific_if_large(c: Column | str, above: float = 1000.0) -> Column:
    """Plain text below the bound, exponent form above it."""
    c = as_column(c)
    return F.when(c > above, F.format_string("%.1e", c)).otherwise(c.cast("string"))


# --- time ------------------------------------------------------------------

# The text forms field sheets use, in the order they are tried.
DATE_TIME_FORMATS = (
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yy H:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
)
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd")


def parse_time(c: Column | str, formats: Sequence[str] = DATE_TIME_FORMATS) -> Column:
    """Naive timestamp from text, NULL where no format fits."""
    c = as_column(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    c = as_column(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def parse_date_and_time(date: Column | str, time: Column | str) -> Column:
    return parse_time(F.concat_ws(" ", as_column(date), as_column(time)))


def seconds(c: Column | str) -> Column:
    """Naive timestamp as seconds since the epoch, with fractions."""
    return F.unix_micros(as_column(c).cast("timestamp")) / F.lit(1e6)


def elapsed(start: Column | str, stop: Column | str, unit: str = "s") -> Column:
    scale = {"s": 1e6, "min": 6e7, "h": 3.6e9, "d": 8.64e10}[unit]
    micros = (F.unix_micros(as_column(stop).cast("timestamp"))
              - F.unix_micros(as_column(start).cast("timestamp")))
    return micros / F.lit(scale)


def day(c: Column | str) -> Column:
    return F.to_date(as_column(c))


# --- numbers ---------------------------------------------------------------

def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL for a zero divisor."""
    return F.try_divide(as_column(a), as_column(b))


def percent_change(new: Column | str, old: Column | str) -> Column:
    return 100.0 * ratio(as_column(new) - as_column(old), old)


def signif(c: Column | str, digits: int) -> Column:
    """Round to significant digits with a per-row scale."""
    c = as_column(c)
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * power) / power)


def stars(p: Column | str) -> Column:
    """Significance marks from a p-value; NULL stays NULL."""
    p = as_column(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .when(p >= 0.05, ""))


def rounded(names: Iterable[str], digits: int) -> dict[str, Column]:
    """One rounding for many columns, for ``withColumns``."""
    return {n: F.round(F.col(n), digits) for n in names}
