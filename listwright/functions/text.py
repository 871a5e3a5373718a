"""Cleaning of submitted cells, as column expressions: what is missing or unreadable becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed import FALSE_TOKENS, NULL_TOKENS, RISK_LEVELS, TRUE_TOKENS

# Unicode whitespace (with the no-break space) and the byte-order mark.
_SPACES = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACE = r"(?U)[\s\x{FEFF}]"
#: (shape, format) of dates that are not ISO; month names are English.
_DATE_FORMS = [
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "yyyy/M/d H:mm"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} \p{L}{4,} \d{4}$", "d MMMM yyyy"), (r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\p{L}{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
]
_NUMBER = r"^(?:[Rr][Ss]\.?)?([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def cell(c: Column) -> Column:
    t = trimmed(c)
    return F.when(~F.lower(t).isin(NULL_TOKENS), t)


def _leading_number(c: Column) -> Column:
    return F.regexp_extract(c, _NUMBER, 1).try_cast("double")


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


# The readers below take a raw cell, or one already cleaned by ``cell`` (``clean=True``): a job that
# reads many columns cleans each of them once, in a projection of its own.

def _value(c: Column, clean: bool) -> Column:
    return c if clean else cell(c)


def numeric_prefix(c: Column, clean: bool = False) -> Column:
    """Longest leading number after currency signs, separators and spaces; may overflow to infinity."""
    return _leading_number(F.translate(_value(c, clean), "₹," + _SPACES, ""))


def number(c: Column, clean: bool = False) -> Column:
    return finite(numeric_prefix(c, clean))


def integer(c: Column, clean: bool = False) -> Column:
    return F.floor(number(c, clean) + 0.5).cast("long")


def flag(c: Column, clean: bool = False) -> Column:
    low = F.lower(_value(c, clean))
    return F.when(low.isin(TRUE_TOKENS), True).when(low.isin(FALSE_TOKENS), False)


def pipe_list(c: Column, clean: bool = False) -> Column:
    parts = F.filter(F.transform(F.split(_value(c, clean), r"\|"), trimmed), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def instant(c: Column, clean: bool = False) -> Column:
    """Dates with or without a time (UTC where there is no offset): ISO, then the other common forms. A time alone is no date."""
    raw = _value(c, clean)
    iso_form = F.when(raw.rlike(r"^[+-]?\d{4,}(-|$)"), raw.try_cast("timestamp"))
    return F.coalesce(iso_form, *[F.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(form))) for shape, form in _DATE_FORMS])


def risk_level(c: Column, clean: bool = False) -> Column:
    low = F.lower(_value(c, clean))
    return F.when(low.isin(RISK_LEVELS), low)


def display_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{_SPACE}+", " "))


def match_name(c: Column) -> Column:
    """Third dedupe key: lower case, everything but letters, digits and spaces dropped, spaces collapsed."""
    letters = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(letters, r"(?U)\s+", " "))


def size_cm(c: Column, clean: bool = False) -> Column:
    """'30 x 20 x 25 cm' or a JSON object -> struct of three positive sides, else NULL."""
    raw = _value(c, clean)
    sides = "length_cm double, width_cm double, height_cm double"
    names = [("lengthCm", "length_cm", "length"), ("widthCm", "width_cm", "width"), ("heightCm", "height_cm", "height")]
    parsed = F.from_json(raw, ", ".join(f"`{n}` string" for group in names for n in group))

    def three(l: Column, w: Column, h: Column) -> Column:
        return F.when((l > 0) & (w > 0) & (h > 0), F.struct(l.alias("length_cm"), w.alias("width_cm"), h.alias("height_cm"))).cast(f"struct<{sides.replace(' double', ':double')}>")

    from_object = three(*[F.coalesce(*[parsed[n].try_cast("double") for n in group]) for group in names])
    bare = F.regexp_replace(F.lower(raw), "cm|mm|in|inches", "")
    parts = F.filter(F.transform(F.split(bare, "[x×*]"), lambda p: _leading_number(trimmed(p))), lambda v: (v > 0) & (v < float("inf")))
    from_text = F.when(F.size(parts) == 3, three(*[F.get(parts, F.lit(i)) for i in range(3)]))
    return F.when(raw.startswith("{"), from_object).otherwise(from_text)


def has_inch_or_mm(c: Column, clean: bool = False) -> Column:
    return F.coalesce(F.lower(_value(c, clean)).rlike(r"\d\s*(mm|in|inches)\b"), F.lit(False))


def identity_key(marketplace: Column, external_id: Column, url: Column) -> Column:
    return F.when(
        external_id.isNotNull() & (external_id != ""), F.concat_ws("::", marketplace, F.lit("id"), external_id)
    ).otherwise(F.concat_ws("::", marketplace, F.lit("url"), url))


def name_key(marketplace: Column, normalized_name: Column) -> Column:
    return F.concat_ws("::", marketplace, F.lit("name"), normalized_name)


def product_key(identity: Column) -> Column:
    return F.sha2(identity, 256)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
