"""Cleaning of month texts, number texts and names, all as column expressions."""

from pyspark.sql import functions as F

from lunario.fixed import MISSING_MARKERS, MONTH_NAMES
from lunario.functions.columns import computed_once

# Month text formats (fixed values): year-month prefix, day/month/year prefix,
# month/year or month-year, "<name> de <year>", "<name> <year>" or "<name>-<year>".
MONTH_TEXT = (
    r"^(?:(\d{4})-(\d{2}).*"
    r"|\d{2}/(\d{2})/(\d{4}).*"
    r"|(\d{2})[/-](\d{4})"
    r"|([a-záéíóúü]+)\s+de\s+(\d{4})"
    r"|([a-záéíóúü]+)[-\s](\d{2,4}))$"
)
# Only the groups of the matching format are non-empty; the mark between year
# and month occurs in no text, so what does not match has no second part.
MARK = "\u0001"
YEAR_AND_MONTH = f"$1$4$6$8$10{MARK}$2$3$5$7$9"

# A number as try_cast should see it: no type suffixes, no NaN or Infinity.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Several dots, or a dot before exactly three digits at the end or a comma.
THOUSANDS_DOTS = r"\..*\.|\.\d{3}(,|$)"
DECIMAL_COMMA = r"^[^.]*,[^.]*$"


# all white space of Unicode, with the separators of ASCII
WHITE_SPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(col):
    return F.btrim(col, F.lit(WHITE_SPACE))


def _month_map(months):
    return F.create_map(*[F.lit(x) for item in months.items() for x in item])


def month_of_name(name):
    """Month number of a Spanish month name; null when unknown."""
    return F.try_element_at(_month_map(MONTH_NAMES), F.lower(name))


def month_token(col):
    """The text reduced to "<year><mark><month token>" where it has a known format."""
    return F.regexp_replace(F.lower(strip(col)), MONTH_TEXT, YEAR_AND_MONTH)


def month_of_token(token):
    """First day of the month in a token, or null.

    One lookup turns names and two-digit numbers alike into a month and
    rejects everything else.
    """
    months = MONTH_NAMES | {f"{m:02d}": m for m in range(1, 13)}
    month = F.try_element_at(_month_map(months), F.split_part(token, F.lit(MARK), F.lit(2)))
    year = F.split_part(token, F.lit(MARK), F.lit(1)).try_cast("int")
    return F.make_date(year + F.when(year < 100, 2000).otherwise(0), month, F.lit(1))


def normalize_month(col):
    """First day of the month written in ``col``, or null."""
    return month_of_token(month_token(col))


def with_month(df, raw, name="ds"):
    """Add the month written in column ``raw``, matching each text once."""
    matched = computed_once(df, {"month_token": month_token(F.col(raw))})
    return matched.withColumn(name, month_of_token(F.col("month_token"))).drop("month_token")


def is_missing(raw):
    return raw.isNull() | strip(raw).isin(MISSING_MARKERS)


def clean_number_text(raw):
    """Plain decimal text: thousands dots dropped, decimal comma to point."""
    s = strip(raw)
    return (
        F.when(s.rlike(THOUSANDS_DOTS), F.translate(s, ",.", "."))
        .when(s.rlike(DECIMAL_COMMA), F.translate(s, ",", "."))
        .otherwise(s)
    )


def coerce_number(text):
    """Double, or null for anything that is not a finite decimal number."""
    value = text.try_cast("double")
    return F.when(text.rlike(PLAIN_NUMBER) & (F.abs(value) < float("inf")), value)


def clean_number(raw):
    """Value of a number cell; null for missing markers and unreadable text."""
    return F.when(~is_missing(raw), coerce_number(clean_number_text(raw)))


def with_value(df, raw, name="y"):
    """Add the value of number column ``raw``, cleaning each text once."""
    plain = F.when(~is_missing(F.col(raw)), clean_number_text(F.col(raw)))
    return computed_once(df, {"plain_number": plain}).withColumn(
        name, coerce_number(F.col("plain_number"))
    ).drop("plain_number")


def round_half_even(y):
    return F.bround(y, 0).cast("bigint")


def percent_text(x):
    return F.format_string("%.1f%%", x)


def sanitize_name(col):
    """Everything that is not a letter, digit or underscore becomes one."""
    return F.regexp_replace(col, r"(?U)[^\w]", "_")


def sheet_name(col):
    """A name of at most 31 characters; a longer one is cut and ends in a digest of the whole, so names stay apart."""
    cut = F.concat(F.substring(col, 1, 22), F.lit("_"), F.substring(F.md5(col.cast("binary")), 1, 8))
    return F.regexp_replace(F.when(F.length(col) > 31, cut).otherwise(col), r"[\\/*?:\[\]]", "_")


def export_name(metric, scope, attribute, models):
    """File name of an export; ``models`` is an array of model names."""
    where = F.when(
        (scope == "atributo") & (F.coalesce(attribute, F.lit("")) != ""),
        F.concat(F.lit("por_"), sanitize_name(attribute)),
    ).otherwise(scope)
    return F.concat(
        F.lit("Pronostico_"),
        F.concat_ws("_", sanitize_name(metric), where, F.array_join(models, "_")),
        F.lit(".xlsx"),
    )
