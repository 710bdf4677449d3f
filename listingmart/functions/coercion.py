"""Text-to-value expressions. Every function maps a Column to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.schema import SENTINEL

# Unicode blanks plus the four ASCII separators that Python also takes for blanks.
BLANKS = r"(?U)[\s\x1c-\x1f]+"

# Texts of signs and Latin letters alone, in which there is no blank to look for.
UNBROKEN = r"^[!-~\u00C0-\u024F]+$"

# The same characters one by one: none of them is inside a spelling of yes or no, so these need trimming only.
BLANK_CHARACTERS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Plain decimal numbers and infinity. Without this guard a cast would also take Java's "1.0d".
NUMBER = (
    r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    r"|^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"
)

# Spellings of yes and no, compared in lower case.
TRUE_WORDS = ("true", "1", "1.0", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "0.0", "no", "n", "f")

# Field texts that a CSV reader of data frames takes for "missing".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def squeeze(c: str) -> str:
    """SQL that collapses every run of blanks to one space and strips the ends."""
    return f"trim(regexp_replace(cast({c} AS string), r'{BLANKS}', ' '))"


def normalize_city(column: str) -> Column:
    """Strip, lower-case and collapse inner blanks to one."""
    text = f"cast(`{column}` AS string)"
    return F.expr(f"lower(if({text} RLIKE r'{UNBROKEN}', {text}, {squeeze(text)}))")


def slug(column: str) -> Column:
    """Strip, lower-case and join words with an underscore."""
    return F.expr(f"replace(lower({squeeze(f'`{column}`')}), ' ', '_')")


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TEXTS), c)


def to_number(column: str, dtype: T.DataType) -> Column:
    """Double value of a column; text that is not a plain number, and NaN, become null."""
    if isinstance(dtype, T.StringType):
        return F.expr(f"if(`{column}` RLIKE r'{NUMBER}', try_cast(`{column}` AS double), NULL)")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.expr(f"nullif(cast(`{column}` AS double), double('NaN'))")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.expr(f"cast(`{column}` AS double)")
    return F.lit(None).cast("double")


def to_whole_number(column: str, dtype: T.DataType) -> Column:
    """Double value with the "unknown" sentinel replaced by null."""
    return F.nullif(to_number(column, dtype), F.lit(SENTINEL))


def to_int(column: str) -> Column:
    """Integer nearest to a double (ties to even); the sentinel and values out of range become null."""
    return F.expr(f"try_cast(rint(nullif(`{column}`, {SENTINEL!r}D)) AS int)")


def to_boolean(column: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.col(column)
    if isinstance(dtype, T.NumericType):
        return F.expr(f"CASE `{column}` WHEN 1 THEN true WHEN 0 THEN false END")
    spellings = F.create_map(*(F.lit(x) for word in TRUE_WORDS for x in (word, True)), *(F.lit(x) for word in FALSE_WORDS for x in (word, False)))
    text = F.col(f"`{column}`").cast("string")
    return F.coalesce(spellings[F.lower(text)], spellings[F.lower(F.trim(text, F.lit(BLANK_CHARACTERS)))])


def to_month(column: str, dtype: T.DataType) -> Column:
    c = F.col(column)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return F.try_to_timestamp(c.cast("string")).cast("date")
