"""Well positions, display labels and result classes on the 8 x 12 plate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.functions.text import blank_to_null, folded, strip
from platewise.schema import PLATE_ROWS, RESULT_CODES

# A letter A-H of any case, then digits; text behind the digits is ignored.
_POSITION = f"(?i)^([{PLATE_ROWS}])([0-9]+)"
# The same with a number from 1 to 12, leading zeros allowed.
_ON_PLATE = f"(?i)^[{PLATE_ROWS}]0*([1-9]|1[0-2])(?![0-9])"


def plate_letter(well: Column) -> Column:
    """Row letter A-H, NULL if the well name has no position."""
    return F.upper(F.nullif(F.regexp_extract(strip(well), _POSITION, 1), F.lit("")))


def plate_number(well: Column) -> Column:
    """Column number as written (not limited to 1-12), NULL without a position."""
    return F.nullif(F.regexp_extract(strip(well), _POSITION, 2), F.lit("")).try_cast("int")


def has_position(well: Column) -> Column:
    """Does the name start with a plate position, inside the plate or not?"""
    return F.coalesce(strip(well).rlike(_POSITION), F.lit(False))


def on_plate(well: Column) -> Column:
    """Is the position one of A1 to H12? One match, so it is cheap as a filter."""
    return F.coalesce(strip(well).rlike(_ON_PLATE), F.lit(False))


def letter_index(letter: Column) -> Column:
    """0 for A up to 7 for H."""
    return F.ascii(letter) - F.lit(ord(PLATE_ROWS[0]))


def well_label(sample_label: Column, content: Column) -> Column:
    """Sample label, the content where that is blank, else ''."""
    label = F.nullif(blank_to_null(sample_label), F.lit("nan"))
    return F.coalesce(label, strip(content), F.lit(""))


def result_code(result: Column) -> Column:
    """Number of a known result, NULL otherwise."""
    word = folded(result)
    code = F.lit(None).cast("int")
    for name, number in RESULT_CODES.items():
        code = F.when(word == name, F.lit(number)).otherwise(code)
    return code


def result_class(result: Column) -> Column:
    """Known result word, ``empty`` otherwise."""
    word = folded(result)
    return F.when(word.isin(list(RESULT_CODES)), word).otherwise("empty")
