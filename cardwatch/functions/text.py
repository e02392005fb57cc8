"""Text normalisation shared by the batch and the streaming path."""

from pyspark.sql import Column, functions as F

from cardwatch.schema import MERCHANT_PREFIX, NULL_TEXT


def strip(value: Column) -> Column:
    """Remove all surrounding white space; SQL ``trim`` would only remove blanks."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def merchant_clean(merchant: Column, anchored: bool = True) -> Column:
    """Drop the prefix that leaks the label: one at the start, or (compat) wherever it stands."""
    bare = (F.regexp_replace(merchant, f"^{MERCHANT_PREFIX}", "") if anchored
            else F.replace(merchant, F.lit(MERCHANT_PREFIX), F.lit("")))
    return strip(bare)


def card_number(value: Column) -> Column:
    """Digits as text, also when a reader delivered the number as a double."""
    return value.try_cast("decimal(20,0)").cast("string")


def card_uid(cc_num: Column, dob: Column, zip_code: Column) -> Column:
    """Null in any part gives null, so such rows can be set aside (concat_ws would skip the part)."""
    return F.concat(cc_num, F.lit("_"), dob.cast("date").cast("string"), F.lit("_"), zip_code)


def category_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL_TEXT))
