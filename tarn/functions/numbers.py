"""Column functions that read numbers, dates and booleans from text, and compare numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
#: Words that scale a number.
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12}
#: Cells that say "nothing".
NOTHING = ("", "-", "—", "N/A", "n/a")
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def parse_number(text: Column) -> Column:
    """A cell's number or null: thousands separators, currency and per cent signs go; (x) is negative."""
    t = F.trim(text)
    negative = t.rlike(r"^\(.*\)$")
    bare = F.trim(F.regexp_replace(t, r"[,$%()]", ""))
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(t.isin(*NOTHING), F.lit(None)).when(negative, -value).otherwise(value)


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def parse_int(text: Column) -> Column:
    """The first integer in a text, thousands separators allowed."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+", 0).try_cast("long")


def whole(number: Column) -> Column:
    """A floating number as an integer if it is integral, else null."""
    return F.when(number == F.floor(number), number.try_cast("long"))


#: Accepted forms of dates, as (pattern, format).
DATES = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^\d{4}$", "yyyy"))


def parse_date(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(*[F.when(t.rlike(p), F.to_date(F.try_to_timestamp(t, F.lit(f)))) for p, f in DATES])


#: What counts as a number in a text.
FOUND = r"(\()?([$€£])?(\d[\d,]*(?:\.\d+)?)(\))?\s?(%|(?:thousand|million|billion|trillion|mm|bn|k|m|b)\b)?"


def extract_numbers(text: Column) -> Column:
    """All numbers of a text in order: array of (value, scaled, unit); $(1.5) is negative, 3 million scales, 5% has the unit %."""
    parts = [F.regexp_extract_all(F.lower(text), F.lit(FOUND), F.lit(g)) for g in (1, 2, 3, 4, 5)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("o", "c", "n", "e", "s"), strict=True)])
    scale = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])

    def one(x: Column) -> Column:
        value = F.regexp_replace(x["n"], ",", "").cast("double")
        value = F.when((x["o"] == "(") & (x["e"] == ")"), -value).otherwise(value)
        by = F.coalesce(F.try_element_at(scale, x["s"]), F.lit(1.0))
        unit = F.when(x["s"] == "%", "%").when(x["c"] != "", x["c"]).otherwise("")
        return F.struct(value.alias("value"), (value * by).alias("scaled"), unit.alias("unit"))

    return F.transform(zipped, one)


def close(a: Column, b: Column, rel: float = 1e-4, least: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(least))


def numbers_match(expected: Column, found: Column) -> Column:
    """Whether one of ``found`` (array of `extract_numbers`) is the expected number raw, scaled, or as a percentage."""
    per_cent = lambda x: F.when(x["unit"] == "%", x["value"] / 100)
    return F.exists(found, lambda x: close(x["value"], expected) | close(x["scaled"], expected) | F.coalesce(close(per_cent(x), expected), F.lit(False)))


#: What the words behind a number mean where an answer is held against its evidence.
UNITS = {
    "%": "percent", "percent": "percent", "percentage point": "percent", "percentage points": "percent",
    "bps": "basis_points", "basis point": "basis_points", "basis points": "basis_points",
    "thousand": "thousand", "m": "million", "mm": "million", "million": "million", "bn": "billion", "billion": "billion", "trillion": "trillion",
}
#: What a critic counts as a number.
STRICT = (
    r"(?i)(?<![A-Za-z0-9_])([$€£])?(\(?-?\d+(?:,\d{3})*(?:\.\d+)?\)?)\s*"
    r"(%|percent|percentage points?|bps|basis points?|thousand|million|billion|trillion|mm|bn|m)?(?![A-Za-z0-9_])"
)


def strict_numbers(text: Column) -> Column:
    """All numbers of a text in order, citation marks left out: array of (value decimal, unit). A unit is percent,
    basis_points, a scale word or currency; a number without one has null. (x) is negative; broken brackets are no number."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[c\d+\]", " ")
    signs, digits, words = (F.regexp_extract_all(bare, F.lit(STRICT), F.lit(g)) for g in (1, 2, 3))
    zipped = F.arrays_zip(signs.alias("s"), digits.alias("d"), words.alias("w"))
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])

    def one(x: Column) -> Column:
        plain = F.regexp_replace(x["d"], ",", "")
        negative = plain.rlike(r"^\(.*\)$")
        value = F.when(negative, F.concat(F.lit("-"), F.regexp_replace(plain, r"[()]", ""))).otherwise(plain).try_cast("decimal(38,10)")
        word = F.regexp_replace(F.lower(x["w"]), r"\s+", " ")
        return F.struct(value.alias("value"), F.coalesce(F.try_element_at(units, word), F.when(x["s"] != "", "currency")).alias("unit"))

    return F.filter(F.transform(zipped, one), lambda x: x["value"].isNotNull())


def strict_match(said: Column, held: Column) -> Column:
    """Whether one of ``held`` (array of `strict_numbers`) is exactly this number; a number said without a unit fits any."""
    return F.exists(held, lambda x: (x["value"] == said["value"]) & (said["unit"].isNull() | x["unit"].eqNullSafe(said["unit"])))
