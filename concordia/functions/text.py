"""Cleaning of names, addresses and ids as column expressions; all null-safe: null gives ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Full-width digits to ASCII, any run of white space to one space, stripped."""
    return collapse(F.translate(_text(c), WIDE_DIGITS, DIGITS))


def entity_text(*parts: Column) -> Column:
    """The cleaned parts that aren't empty, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(clean_text(p), F.lit("")) for p in parts])


def entity_text_nullsafe(name: Column, addr: Column) -> Column:
    """Name and address as they are, null as empty."""
    return strip(F.concat(_text(name), F.lit(" "), _text(addr)))


def clean_store_name(c: Column) -> Column:
    c = F.regexp_replace(_text(c), r"^[^-]*-", "")
    c = F.regexp_replace(F.regexp_replace(c, "店$", ""), "[（(][^）)]*[）)]", "")
    return strip(F.regexp_replace(c, r"(?U)[·\-\s]+", " "))


def clean_address(c: Column) -> Column:
    c = F.regexp_replace(_text(c), "^(上海市?|北京|天津|重庆)", "")
    c = F.translate(F.regexp_replace(c, "眼镜店|眼镜城|眼镜", ""), "０１", "01")
    return collapse(c)


#: Legal forms, deleted in this order.
COMPANY_FORMS = ("有限公司", "有限责任公司", "股份有限公司", "个人独资企业", "个体工商户", "合伙企业", "工作室")


def clean_company(c: Column) -> Column:
    c = _text(c)
    for form in COMPANY_FORMS:
        c = F.replace(c, F.lit(form), F.lit(""))
    return collapse(F.regexp_replace(c, "[（(][^）)]*[）)]", ""))


def canonical_id(c: Column) -> Column:
    return F.upper(strip(_text(c)))


def slug(*parts: Column, at: Column | None = None) -> Column:
    """A name for an experiment: its parts, in their case, with an underscore between them and for each character that isn't an ASCII letter or digit; behind it the time `at`, if given."""
    name = F.regexp_replace(F.concat_ws("_", *[F.nullif(_text(p), F.lit("")) for p in parts]), "[^a-zA-Z0-9]", "_")
    return name if at is None else F.concat(name, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def has_text(*parts: Column) -> Column:
    """At least one of the parts isn't blank: queries without any are left out before they are compared."""
    return entity_text(*parts) != ""


def squeezed(c: Column) -> Column:
    """Stripped, without spaces and ideographic spaces."""
    return F.translate(strip(_text(c)), " 　", "")


def near_duplicate(a: Column, b: Column, prefix: int = 20, distance: int = 3) -> Column:
    """Both longer than 2, and their prefixes fewer than `distance` edits apart."""
    near = F.levenshtein(F.substring(a, 1, prefix), F.substring(b, 1, prefix), distance - 1) >= 0
    return (F.length(a) > 2) & (F.length(b) > 2) & near


def deletions(c: Column) -> Column:
    """c with none, one and two characters left out, each once; c: three characters or more. Texts two edits apart or fewer share one of them."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.array_distinct(F.flatten(F.transform(F.concat(F.array(c), without(c)), lambda x: F.concat(F.array(x), without(x)))))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length: the default pair scorer."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
