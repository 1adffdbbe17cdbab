"""Scalar building blocks of the rules, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, trimmed

NAME_NOISE = r"[\s\p{Z}\p{P}\p{S}]"


def normalized_name(name: Column) -> Column:
    """Lower case without white space, punctuation and symbols; null gives empty text."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), NAME_NOISE, "")


def without_spot(name: Column) -> Column:
    """Normalised name without marks of a spot inside a place: side letters in brackets, block, floor, unit."""
    # The side words and the unit words.
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\((?:좌|우|상|하|앞|뒤|동|서|남|북|[0-9]+|[A-Za-z])\)", "")
    return F.regexp_replace(normalized_name(bare), r"([0-9]+|[a-z])(동|층|호)", "")


def compact(text: Column) -> Column:
    """Lower case without any white space: the form searches compare."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS, "")


def parsed_number(text: Column) -> Column:
    """A finite decimal number written as text, else null; suffixes, hex and the words for infinity don't count."""
    body = trimmed(text)
    return F.when(F.rlike(body, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), body.try_cast("double"))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def coordinate_status(x: Column, y: Column, x_bounds: tuple[float, float] = (124, 132), y_bounds: tuple[float, float] = (33, 39)) -> Column:
    """``missing``, ``swapped``, ``outOfRange`` or ``ok``; bounds belong inside, the first that holds counts."""
    return (
        F.when(x.isNull() | y.isNull(), "missing")
        .when(x.between(*y_bounds) & y.between(*x_bounds), "swapped")
        .when(~x.between(*x_bounds) | ~y.between(*y_bounds), "outOfRange")
        .otherwise("ok")
    )


def fixed(value: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", value)


def number_text(value: Column) -> Column:
    """A number as people write it: whole numbers without a decimal point."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def distance_text(metres: Column) -> Column:
    whole = F.floor(metres + 0.5).cast("bigint")
    return F.when(metres < 1000, F.concat(whole.cast("string"), F.lit("m"))).otherwise(F.concat(fixed(metres / 1000, 1), F.lit("km")))


def grouped_number(value: Column) -> Column:
    return F.format_number(value, 0)


def run_tag(run_id: Column) -> Column:
    """``2031-03-03T06:10`` to ``snap-2031-03-03-0610``; other text gives null."""
    parts = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2})$"
    return F.when(F.rlike(run_id, F.lit(parts)), F.regexp_replace(run_id, parts, "snap-$1-$2$3"))


def tag_label(tag: Column) -> Column:
    parts = r"^snap-([0-9]{4}-[0-9]{2}-[0-9]{2})-([0-9]{2})([0-9]{2})$"
    return F.when(F.rlike(tag, F.lit(parts)), F.regexp_replace(tag, parts, "$1 $2:$3")).otherwise(tag)


def local_minute(instant: Column, zone: str = "Asia/Seoul") -> Column:
    """A UTC instant without time zone, to the minute of ``zone``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant), "yyyy-MM-dd'T'HH:mm")


def time_ago(instant: Column, now: Column) -> Column:
    """How long before ``now`` an instant was; instants to come are just now."""
    minutes = F.timestamp_diff("MINUTE", instant, now)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("bigint").cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("bigint").cast("string"), F.lit(" d ago")))
    )


def similar_names(a: Column, b: Column, similarity: float = 0.8) -> Column:
    """Edit distance at most ``1 - similarity`` of the longer name, in letters."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * (1 - similarity) + 1e-9).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)


def decoded_url(text: Column) -> Column:
    """Percent escapes decoded; null where they don't form valid text."""
    out = F.try_url_decode(text)
    broken = F.contains(out, F.lit("�")) & ~F.contains(text, F.lit("�"))
    return F.when(~F.coalesce(broken, F.lit(True)), out)


def parse_region_address(address: Column, *, city: str, districts: Sequence[str], elsewhere: Sequence[str], shared: Sequence[str] = ()) -> Column:
    """``struct(in_city, gu, ambiguous)`` read from the head of an address.

    The city's name ends the word or is followed by a district; without a city a
    leading district is enough, but ``ambiguous`` where other cities share its
    name.  Addresses that begin with another province are outside; all others
    are unknown (null).
    """
    value = trimmed(address)
    names = "|".join(districts) or "(?!)"
    lead = f"^({names})(?![가-힣])"

    def area(inside: Column | bool | None, gu: Column | None = None, ambiguous: Column | bool = False) -> Column:
        flag = F.lit(inside) if not isinstance(inside, Column) else inside
        return F.struct(
            flag.cast("boolean").alias("in_city"), (F.lit(None).cast("string") if gu is None else gu).alias("gu"), (F.lit(ambiguous) if not isinstance(ambiguous, Column) else ambiguous).alias("ambiguous")
        )

    def leading(text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, lead, 1), F.lit(""))

    rest = F.regexp_replace(value, f"^(?:{city})", "")
    has_city = F.rlike(value, F.lit(f"^(?:{city})"))
    after_city = leading(trimmed(rest))
    return (
        F.when(value == "", area(None))
        .when(has_city & ((rest == "") | F.rlike(rest, F.lit(f"^{SPACE_CLASS}"))), area(True, after_city))
        .when(has_city & leading(rest).isNotNull(), area(True, leading(rest)))
        .when(leading(value).isNotNull(), area(True, leading(value), leading(value).isin(*shared) if shared else False))
        .when(F.rlike(value, F.lit("^(" + ("|".join(elsewhere) or "(?!)") + ")")), area(False))
        .otherwise(area(None))
    )
