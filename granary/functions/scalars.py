"""Scalar functions used by the operators and open to users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, each 1024 times the one before.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

# The texts that CSV readers in the pandas world take as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Decimal or exponent notation, and the spelled infinities.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """Column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sha1_10(c: Column | str) -> Column:
    """First ten hex digits of SHA-1."""
    return F.substring(F.sha1(as_col(c).cast("binary")), 1, 10)


def _halves(x):
    """Split a double into two with at most 26 significant bits each."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    return high, x - high


def nearest_decimal(c: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` decimals by its exact binary value, ties to even.

    This is what C and Python print; the JVM rounds the shortest decimal text
    instead. The rounding error of ``x * 10^digits`` is itself exact in doubles.
    """
    x, scale = as_col(c).cast("double"), 10.0**digits
    product = x * F.lit(scale)
    (high, low), (scale_high, scale_low) = _halves(x), _halves(scale)
    error = (
        (high * scale_high - product) + high * scale_low + low * scale_high
    ) + low * scale_low
    below = F.floor(product).cast("double")
    past_half = (product - below - 0.5) + error
    up = (past_half > 0) | ((past_half == 0) & (F.pmod(below, F.lit(2.0)) == 1))
    return (below + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)


def human_bytes(c: Column | str) -> Column:
    """Byte count with the largest unit that keeps the number below 1024."""
    size = as_col(c).cast("double")
    last = len(SIZE_UNITS) - 1
    value, unit = size / 1024.0**last, F.lit(SIZE_UNITS[last])
    for power in range(last - 1, -1, -1):
        fits = size < 1024.0 ** (power + 1)
        value = F.when(fits, size / 1024.0**power).otherwise(value)
        unit = F.when(fits, SIZE_UNITS[power]).otherwise(unit)
    return F.concat(fixed_decimals(value, 1), unit)


def file_size_text(c: Column | str) -> Column:
    """Three-tier file size: KB up to one MB, MB up to one GB, then GB; two decimals."""
    size = as_col(c).cast("double")
    power = F.when(size > 1024.0**3, 3).when(size > 1024.0**2, 2).otherwise(1)
    unit = F.get(F.array(F.lit(" KB"), F.lit(" MB"), F.lit(" GB")), power - 1)
    return F.concat(fixed_decimals(size / F.pow(F.lit(1024.0), power), 2), unit)


def normalized_name(c: Column | str) -> Column:
    return F.lower(F.trim(as_col(c)))


def is_label_name(c: Column | str) -> Column:
    return normalized_name(c) == F.lit("label")


def has_suffix(c: Column | str, suffix: str) -> Column:
    """Suffix test that ignores case."""
    return F.lower(as_col(c)).endswith(suffix.lower())


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(as_col(c), "/"), -1)


def half_even(c: Column | str) -> Column:
    """Round to an integer, ties to the even neighbour."""
    return F.rint(as_col(c).cast("double"))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp; NULL stays NULL (``least``/``greatest`` would turn it into a bound)."""
    c = as_col(c)
    return F.when(c > F.lit(high), F.lit(high)).when(c < F.lit(low), F.lit(low)).otherwise(c)


def at_least(c: Column | str, low: float) -> Column:
    c = as_col(c)
    return F.when(c < F.lit(low), F.lit(low)).otherwise(c)


def at_most(c: Column | str, high: float) -> Column:
    c = as_col(c)
    return F.when(c > F.lit(high), F.lit(high)).otherwise(c)


def safe_divide(a: Column | str, b: Column | str, floor: float = 1.0) -> Column:
    """``a / max(b, floor)``."""
    return as_col(a).cast("double") / F.greatest(as_col(b).cast("double"), F.lit(float(floor)))


def finite_or_null(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    c = as_col(c)
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def present(c: Column | str) -> Column:
    """Raw CSV text with the missing-value tokens turned into NULL."""
    c = as_col(c)
    return F.when(~c.isin(*MISSING_TOKENS), c)


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    c = as_col(c)
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def epoch_to_timestamp(c: Column | str) -> Column:
    return F.timestamp_seconds(as_col(c))


def clock_text(c: Column | str) -> Column:
    return F.date_format(as_col(c), "HH:mm:ss")


def datetime_text(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss")


def _whole_seconds(c: Column | str) -> Column:
    return F.floor(as_col(c)).cast("bigint")


def hms(c: Column | str) -> Column:
    """Seconds as H:MM:SS; whole days come first as ``N day(s), ``."""
    total = _whole_seconds(c)
    days = F.floor(total / 86400).cast("bigint")
    rest = total % 86400
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600).cast("bigint"),
        F.floor(rest % 3600 / 60).cast("bigint"),
        rest % 60,
    )
    return (
        F.when(days == 0, clock)
        .when(days == 1, F.concat(F.lit("1 day, "), clock))
        .otherwise(F.concat(days.cast("string"), F.lit(" days, "), clock))
    )


def hms_padded(c: Column | str) -> Column:
    """Seconds as HH:MM:SS, hours unbounded."""
    total = _whole_seconds(c)
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(total / 3600).cast("bigint"),
        F.floor(total % 3600 / 60).cast("bigint"),
        total % 60,
    )


def hours_minutes(c: Column | str) -> Column:
    """Seconds as ``Hh Mm``."""
    total = _whole_seconds(c)
    return F.format_string(
        "%dh %dm", F.floor(total / 3600).cast("bigint"), F.floor(total % 3600 / 60).cast("bigint")
    )


def map_get(m: Column | str, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(as_col(m), F.lit(key)), F.lit(default))


def map_size(m: Column | str) -> Column:
    """Number of entries; NULL counts as empty."""
    m = as_col(m)
    return F.when(m.isNull(), F.lit(0)).otherwise(F.size(m)).cast("bigint")


def params_text(m: Column | str) -> Column:
    """``k=v, k=v`` in the order of the map."""
    return F.array_join(
        F.transform(F.map_entries(as_col(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        ", ",
    )


def canonical_value(c: Column | str) -> Column:
    """One text per value: ``1``, ``1.0`` and ``1e0`` are the same parameter value."""
    c = as_col(c)
    return F.coalesce(to_number(c).cast("string"), c)


def fixed_decimals(c: Column | str, digits: int = 4, width: int = 0) -> Column:
    """Number with a fixed count of decimals, padded on the left to ``width``."""
    value = as_col(c).cast("double")
    text = F.format_string(f"%{width or ''}.{digits}f", nearest_decimal(value, digits))
    return F.when(value.isNotNull(), text)


def thousands(c: Column | str, digits: int = 0) -> Column:
    return F.format_number(as_col(c), digits)


def json_text(c: Column | str) -> Column:
    return F.to_json(as_col(c))


def parse_json(c: Column | str, schema: str) -> Column:
    return F.from_json(as_col(c), schema)


def std_pop_of(values: Column) -> Column:
    """Population standard deviation of an array of doubles; NULL for an empty one."""
    mean = mean_of(values)
    squares = F.aggregate(
        values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)
    )
    return F.sqrt(squares / F.nullif(F.size(values), F.lit(0)))


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.nullif(F.size(values), F.lit(0))


def coefficient_of_variation(mean: Column, std: Column) -> Column:
    """``std / mean``; 0 unless the mean is positive."""
    return F.when(mean > 0, std / mean).otherwise(F.lit(0.0))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def outer(x: Column, y: Column) -> Column:
    """Row-major outer product as one flat array."""
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: a * b)))


def quadratic_form(x: Column | list[Column], matrix: list[list[float]]) -> Column:
    """``x' M x`` for a literal matrix, as plain arithmetic; ``x`` is an array or its elements."""
    parts = [F.get(x, F.lit(i)) for i in range(len(matrix))] if isinstance(x, Column) else x
    return reduce(
        lambda total, term: total + term,
        [
            parts[i] * parts[j] * F.lit(float(value))
            for i, row in enumerate(matrix)
            for j, value in enumerate(row)
        ],
    )


def linear_form(x: list[Column], weights: list[float]) -> Column:
    """``w' x`` for literal weights, as plain arithmetic."""
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(x, weights)])


def key_hash(key: Column | str, seed: int | Column) -> Column:
    """MD5 of ``key-seed`` as 32 hex digits: a pseudo-random order that does not
    depend on partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(as_col(key).cast("string"), F.lit("-"), seed.cast("string")).cast("binary"))


def unit_interval(hash_hex: Column) -> Column:
    """First eight hex digits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)

