"""Text normalisation, formatting and display columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The marker words left out of a counterparty fingerprint.
REFERENCE_WORDS = ["REF", "REFERENCE", "TRACE", "TRN", "TRANSACTION", "ID", "CONFIRMATION"]


def unicode_fold_udf():
    # Built inside a function so the code travels by value: executors need
    # neither this package nor its path.
    def fold_batch(values: pd.Series) -> pd.Series:
        def folded(text):
            once = unicodedata.normalize("NFKC", text).casefold()
            return unicodedata.normalize("NFKC", once)

        return values.map(folded, na_action="ignore")

    return F.pandas_udf(fold_batch, StringType())


def fold(value: Column) -> Column:
    """NFKC normalisation with case folding.

    ASCII text needs only ``lower``; the UDF sees NULL for it, so Arrow carries
    just the rows that are not ASCII.
    """
    not_ascii = value.rlike(r"[^\x00-\x7F]")
    return F.coalesce(unicode_fold_udf()(F.when(not_ascii, value)), F.lower(value))


def normalize_description(value: Column) -> Column:
    """Folded text with runs of anything but letters and digits as one space."""
    words = F.regexp_replace(fold(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.upper(F.trim(words))


def counterparty_words(normalized: Column) -> Column:
    """Normalised text without numbers and reference markers."""
    keep = F.filter(
        F.split(normalized, " "),
        lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~w.isin(REFERENCE_WORDS),
    )
    return F.array_join(keep, " ")


def blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"(?U)^\s*$")


def clean(value: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def clean_capped(value: Column, limit: int) -> Column:
    return F.substring(clean(value), 1, limit)


def finite_number(value: Column) -> Column:
    """Number from text; NULL for blank, malformed, NaN and infinite input."""
    number = clean(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def slug(value: Column) -> Column:
    """Lower-case key: the words of the name joined by dashes, 60 characters at most."""
    spelled = F.replace(F.lower(value), F.lit("&"), F.lit("and"))
    key = F.array_join(F.regexp_extract_all(spelled, F.lit("[a-z0-9]+"), F.lit(0)), "-")
    return F.coalesce(F.nullif(F.substring(key, 1, 60), F.lit("")), F.lit("unknown"))


def safe_filename(value: Column, position: Column) -> Column:
    name = F.coalesce(F.nullif(value, F.lit("")), F.concat(F.lit("statement_"), position.cast("string")))
    name = F.regexp_replace(name, r"[^A-Za-z0-9_.\- ]+", "_")
    return F.concat(F.lit("bank_"), F.lpad(position.cast("string"), 2, "0"), F.lit("_"), name)


def _marked_digits(value: Column, limit: int, marks: dict[int, str]) -> Column:
    """The first digits of a text; each mark stands before the digit at its place, if there is one."""
    shown = F.substring(digits(F.coalesce(value, F.lit(""))), 1, limit)
    for place in sorted(marks, reverse=True):  # from the end, so that earlier places still count digits only
        shown = F.regexp_replace(shown, rf"(?<=^\d{{{place}}})(?=\d)", marks[place])
    return shown


# Where the marks of each number stand.
def phone_format(value: Column) -> Column:
    return _marked_digits(value, 10, {0: "(", 3: ") ", 6: "-"})


def ssn_format(value: Column) -> Column:
    return _marked_digits(value, 9, {3: "-", 5: "-"})


def ein_format(value: Column) -> Column:
    return _marked_digits(value, 9, {2: "-"})


def _grouped(number: Column) -> Column:
    """Thousands groups and up to three decimals, as a browser prints a number."""
    shortened = F.regexp_replace(F.format_number(number, 3), r"\.?0+$", "")
    return F.when(number == 0, "0").otherwise(shortened)


def usd_format(value: Column) -> Column:
    """Dollar text from typed text; everything but digits and dots is ignored."""
    number = F.regexp_replace(value.cast("string"), r"[^\d.]", "").try_cast("decimal(38,3)")
    return F.coalesce(F.concat(F.lit("$"), _grouped(number)), F.lit(""))


def usd_number(value: Column) -> Column:
    """Dollar text from a number; dash when missing."""
    return F.coalesce(F.concat(F.lit("$"), _grouped(value.cast("decimal(38,3)"))), F.lit(DASH))


def redact_email(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit("*" * 11))


def redact_phone(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit("(XXX) XXX-XXXX"))


DASH = "—"


def exact_decimal(value: Column, scale: int = 2, currency: bool = True) -> Column:
    """Grouped decimal text; no sign on zero, dash when unusable.

    Reads canonical decimal text, not floats. The digit after the last kept one
    decides the rounding, whatever follows it.
    """
    text = clean(value.cast("string"))
    kept = F.regexp_extract(text, rf"^(-?[0-9]+(?:\.[0-9]{{1,{scale + 1}}})?)", 1)
    usable = text.rlike(r"^-?[0-9]+(\.[0-9]+)?\z")
    number = F.when(usable, F.round(kept.try_cast(f"decimal(38,{scale + 1})"), scale))
    grouped = F.format_number(F.abs(number), scale)
    sign = F.when(number < 0, "-").otherwise("")
    unit = F.lit("$" if currency else "")
    return F.coalesce(F.concat(sign, unit, grouped), F.lit(DASH))


def display_date(value: Column) -> Column:
    """``Mon D, YYYY`` from strict ISO text; dash otherwise."""
    pattern = r"^(\d{4})-(0[1-9]|1[0-2])-(\d{2})$"
    text = value.cast("string")
    year, month, day = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    name = F.date_format(F.make_date(F.lit(2000), month.try_cast("int"), F.lit(1)), "MMM")
    shown = F.concat(name, F.lit(" "), day.try_cast("int").cast("string"), F.lit(", "), year)
    return F.coalesce(F.when(text.rlike(pattern), shown), F.lit(DASH))


def display_period(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), F.lit(DASH)).otherwise(
        F.concat(display_date(start), F.lit("–"), display_date(end))
    )


# Characters that the document font shows in another form, or not at all.
_CONTROLS = "".join(map(chr, [*range(0x20), 0x7F]))
_QUOTES = "‘’“”"
_NOT_SHOWN = "[^\\x20-\\x7e–—]"


def printable(value: Column) -> Column:
    """Text limited to what a basic document font can show."""
    plain = F.translate(F.replace(value.cast("string"), F.lit("…"), F.lit("...")), _CONTROLS + _QUOTES, " " * len(_CONTROLS) + "''\"\"")
    return F.coalesce(F.trim(F.regexp_replace(plain, _NOT_SHOWN, "?")), F.lit(""))


def or_dash(value: Column) -> Column:
    return F.coalesce(clean(value.cast("string")), F.lit(DASH))


def eastern(value: Column, pattern: str) -> Column:
    return F.date_format(F.from_utc_timestamp(value, "America/New_York"), pattern)


def first_hop(value: Column) -> Column:
    return clean(F.get(F.split(value, ","), F.lit(0)))


def stable_error_code(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Z][A-Z0-9_]{2,80}$"), value).otherwise(F.lit("UNEXPECTED_ERROR"))


def join_parts(*parts: Column) -> Column:
    """Comma-joined parts without the blank ones; dash when all are blank."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit(DASH))


def page_digest(text: Column, pattern: str, replacement: str) -> Column:
    """Digest of page text after its variable part is put into one form."""
    return F.sha2(F.regexp_replace(text, pattern, replacement), 256)
