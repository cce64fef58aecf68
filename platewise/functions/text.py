"""Text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.schema import BORDERLINE_CQ, CONTROL_CONTENTS

# The characters Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def strip(text: Column) -> Column:
    """Trim all white space, tabs, newlines and no-break blanks included."""
    return F.btrim(text, F.lit(WHITESPACE))


def folded(text: Column) -> Column:
    """Trimmed, lower-case form used wherever words are compared."""
    return F.lower(strip(text))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def to_number(text: Column) -> Column:
    """Text to double; anything that is no plain number becomes NULL."""
    return F.regexp_extract(strip(text), _NUMBER, 0).try_cast("double")


def nan_to_null(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not stay in a Cq column."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def sample_label_clean(label: Column) -> Column:
    """One blank between words, no blank between a number and ``mL``; '' if absent."""
    single = F.regexp_replace(strip(label), _SPACE_RUN, " ")
    volumes = F.regexp_replace(single, r"(?iU)(\d+\.?\d*)\s*mL", "$1mL")
    return F.coalesce(volumes, F.lit(""))


def sample_type(clean_label: Column) -> Column:
    """Sample type of a cleaned label."""
    return F.when(clean_label == "", "Unknown").otherwise(F.replace(clean_label, F.lit(" "), F.lit("_")))


def is_control(content: Column) -> Column:
    return F.coalesce(folded(content).isin(CONTROL_CONTENTS), F.lit(False))


def result_is(result: Column, word: str) -> Column:
    """Never NULL: a missing result is simply not the asked-for one."""
    return F.coalesce(folded(result) == word, F.lit(False))


def is_positive(result: Column) -> Column:
    return result_is(result, "positive")


def is_borderline(target_cq: Column) -> Column:
    return target_cq > BORDERLINE_CQ


def round_even(value: Column, digits: int) -> Column:
    """Round half to even, judged after summation noise is cut off at 9 digits."""
    return F.bround(F.round(value, 9), digits)


def stable(value: Column) -> Column:
    """An unrounded mean or SD without the noise of the order of summation."""
    return F.round(value, 9)


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals, NULL if absent."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", round_even(value, digits)))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))
