"""Free-text fields to numbers and flags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"
NUMBER = r"([+-]?\d+(?:\.\d+)?)"
WHOLE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Texts that mean "no offer".
NO_OFFER = ("", "nan", "none", "no", "n/a")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_double(c: Column) -> Column:
    """Numeric column as a double: NaN becomes null and -0.0 becomes 0.0."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))


def first_number(c: Column) -> Column:
    """First signed number in a text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(c, NUMBER, 1).try_cast("double"), F.lit(0.0))


def offer_flag(c: Column) -> Column:
    """1.0 if the text names an offer, 0.0 for null and for the texts that mean none."""
    text = F.lower(strip(c.cast("string")))
    return F.when(c.isNull() | text.isin(*NO_OFFER), F.lit(0.0)).otherwise(F.lit(1.0))


def number_or_zero(c: Column) -> Column:
    """The number that the whole text spells, 0 for anything else."""
    text = strip(c.cast("string"))
    return F.coalesce(F.when(text.rlike(WHOLE_NUMBER), text.try_cast("double")), F.lit(0.0))
