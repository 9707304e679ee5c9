"""Values of spreadsheet cells: numbers, quantities, dates and booleans from text.

Each function gives null where the text is not such a value, so a count of the
results tells how much of a column parses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import normalized_ascii

#: Words taken as true and false.
TRUE, FALSE = ("true", "yes", "y"), ("false", "no", "n")
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
SLASH_DAY = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
NAMED_DAY = r"^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}$"


def number(text: Column) -> Column:
    """Double of text such as -3.5, $1,200, (42), 7% and 1 000."""
    bare = F.regexp_replace(F.trim(text), r"[$£€,\s]", "")
    negative = bare.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(F.regexp_replace(bare, r"[()]", ""), "%$", "")
    value = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


#: Words that mark a specification, whose numbers are no amount.
SPEC_WORDS = ("kv", "v", "dc", "ac", "amp", "amps", "current", "input", "output", "voltage", "rated", "watt", "watts", "hz")


def quantity(text: Column) -> Column:
    """Double of an amount with a unit: 2m, -5L, or the upper end of 10-20mL or 3 – 4;
    what does not start so is read as a number. Null of a specification (12 V, 50 Hz)."""
    bare = F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))
    low, high = (F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?)(?:\s*[-\u2013]\s*(-?\d+(?:\.\d+)?))?", k) for k in (1, 2))
    words = F.split(normalized_ascii(bare), " ")
    spec = F.arrays_overlap(words, F.array(*map(F.lit, SPEC_WORDS)))
    ends = F.greatest(F.nullif(low, F.lit("")).try_cast("double"), F.nullif(high, F.lit("")).try_cast("double"))
    return F.when(~spec, F.when(low != "", ends).otherwise(number(text)))


def boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE), F.lit(True)).when(word.isin(*FALSE), F.lit(False))


def timestamp(text: Column) -> Column:
    """Timestamp without zone (UTC) of ISO days and times, m/d/yyyy, Month d, yyyy."""
    t = F.trim(text)
    day = lambda fmt: F.try_to_timestamp(t, F.lit(fmt))
    named = F.try_to_timestamp(F.initcap(F.regexp_replace(F.regexp_replace(t, r"[.,]", ""), r"\s+", " ")), F.lit("MMM d yyyy"))
    full = F.try_to_timestamp(F.initcap(F.regexp_replace(F.regexp_replace(t, r"[.,]", ""), r"\s+", " ")), F.lit("MMMM d yyyy"))
    # years of two digits are 1950 to 2049
    year = F.substring_index(t, "/", -1).try_cast("int")
    short = F.try_to_timestamp(F.concat(F.substring_index(t, "/", 2), F.lit("/"), (year + F.when(year < 50, 2000).otherwise(1900)).cast("string")), F.lit("M/d/yyyy"))
    found = (
        F.when(t.rlike(ISO_DAY), day("yyyy-M-d"))
        .when(t.rlike(ISO_TIME), F.try_to_timestamp(F.replace(t, F.lit(" "), F.lit("T"))))
        .when(t.rlike(r"/\d{4}$") & t.rlike(SLASH_DAY), day("M/d/yyyy"))
        .when(t.rlike(r"/\d{2}$") & t.rlike(SLASH_DAY), short)
        .when(t.rlike(NAMED_DAY), F.coalesce(named, full))
    )
    return found.cast("timestamp_ntz")
