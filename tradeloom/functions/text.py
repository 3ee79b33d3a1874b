"""Keys, categories and free-text clean-up."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeloom import config

# White space in the Unicode sense plus the four ASCII separator controls.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def none_if_token(col: Column, tokens=config.NA_TOKENS) -> Column:
    """Null where the text is one of the missing-value tokens."""
    return F.when(~col.isin(*tokens), col)


def extract_int_key(col: Column, on_bad: str = "null") -> Column:
    """First run of digits as a bigint; ``on_bad='fail'`` stops the job instead of giving null."""
    key = F.regexp_substr(col, F.lit(r"\d+")).try_cast("bigint")
    if on_bad == "null":
        return key
    if on_bad == "fail":
        message = F.concat(F.lit("no integer key in: "), F.coalesce(col, F.lit("null")))
        return F.coalesce(key, F.raise_error(message).cast("bigint"))
    raise ValueError(f"on_bad must be 'null' or 'fail', not {on_bad!r}")


def strip_literal(col: Column, text: str = "-") -> Column:
    """Remove every occurrence of a literal text."""
    return F.replace(col, F.lit(text), F.lit(""))


def category_id(prd_key: Column) -> Column:
    """First five characters with hyphens turned into underscores (``AC-HE-…`` → ``AC_HE``)."""
    return F.translate(F.substring(prd_key, 1, 5), "-", "_")


def product_code(prd_key: Column) -> Column:
    """Everything after the six-character category prefix."""
    return F.substr(prd_key, F.lit(7))


def strip_space(col: Column) -> Column:
    return F.regexp_replace(col, _EDGE_SPACE, "")


def standardise_text(col: Column) -> Column:
    """Upper case without white space at either end; null stays null."""
    return strip_space(F.upper(col))


def map_values(col: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Replace whole values; unmapped values pass through and null becomes ``default``."""
    replaced = F.coalesce(_lookup(col, mapping), col)
    return replaced if default is None else F.coalesce(replaced, F.lit(default))


def map_country(col: Column, mapping: Mapping[str, str] = config.COUNTRY_MAP) -> Column:
    """Upper-case country with spelling variants unified."""
    return map_values(F.upper(col), mapping)


def map_gender(col: Column, mapping: Mapping[str, str] = config.GENDER_LABELS) -> Column:
    """``Male``/``Female`` in any case become the label; every other value is kept as it is."""
    return F.coalesce(_lookup(F.upper(col), mapping), col)


def gender_bucket(col: Column, mapping: Mapping[str, str] = config.GENDER_LABELS) -> Column:
    """``Male``, ``Female`` or ``Other``; null, blanks and one-letter codes are ``Other``."""
    return F.coalesce(_lookup(F.upper(strip_space(col)), mapping), F.lit(config.OTHER))


def category_path(category: Column, subcategory: Column) -> Column:
    """``CAT > SUBCAT``; null if either part is null."""
    return F.concat(category, F.lit(" > "), subcategory)


def _lookup(col: Column, mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.create_map(*pairs)[col]
