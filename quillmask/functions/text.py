"""Scalar functions on texts: normalisation, repairs, labels and buckets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmask.functions import vocab
from quillmask.functions.spans import find_all

BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, BLANKS, "")


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose(c: Column) -> Column:
    """Unicode NFC. Texts of code points below U+0300 are composed already; only others go to Python, for the rest it gets nulls."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def decode_entities(c: Column) -> Column:
    """The listed HTML entities, one after the other, so that &amp;lt; is decoded twice."""
    out = c
    for entity, plain in vocab.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def normalise(c: Column, nfc: bool = True) -> Column:
    """NFC, entities, white space, addresses and numbers split over lines, zero-width characters and dashes. Quotes stay as they are."""
    c = decode_entities(compose(c) if nfc else c)
    for needed, regex, to in vocab.REPAIRS:
        c = F.regexp_replace(c, regex, to) if needed is None else F.when(c.rlike(needed), F.regexp_replace(c, regex, to)).otherwise(c)
    return F.translate(c, *vocab.DASHES)


def offset_map(original: Column, normalised: Column) -> Column:
    """One region that maps all of the original to all of the normalised text."""
    return F.array(F.struct(F.lit(0).alias("original_start"), F.length(original).alias("original_end"), F.lit(0).alias("normalized_start"), F.length(normalised).alias("normalized_end")))


def rejoin(c: Column) -> Column:
    """E-mail addresses, phone, card and social security numbers split at a line feed."""
    for regex, to in vocab.REJOINED:
        c = F.regexp_replace(c, regex, to)
    return c


def fix_ocr(c: Column, kind: Column) -> Column:
    """Letters misread for digits where numbers are expected; spaces and two misreadings in addresses; else unchanged."""
    address = c
    for wrong, right in vocab.MISREAD_ADDRESSES:
        address = F.replace(address, F.lit(wrong), F.lit(right))
    return F.when(kind.isin(*vocab.NUMERIC_KINDS), F.translate(c, *vocab.MISREAD_DIGITS)).when(kind == "email", address).otherwise(c)


def regions(name: str) -> Column:
    """Where indicators announce personal data: array<struct<start, end, text, hint>>, by indicator and then place.

    A region ends 100 characters after its indicator or at the end of the line, which must not be the text's first character.
    """
    t = F.col(name)
    out = []
    for regex, hint in vocab.REGION_HINTS:
        def region(x: Column, hint: str = hint) -> Column:
            line = F.call_function("locate", F.lit("\n"), t, x["end"] + 1) - 1
            end = F.least(x["end"] + 100, F.when(line > 0, line).otherwise(F.length(t)))
            return F.struct(x["start"].alias("start"), end.alias("end"), F.substring(t, x["start"] + 1, end - x["start"]).alias("text"), F.lit(hint).alias("hint"))

        out.append(_map(find_all(name, f"(?Ui){regex}"), region))
    return F.flatten(F.array(*out))


def _map(array: Column, fn) -> Column:
    return F.transform(array, lambda x: fn(x))


def luhn(c: Column) -> Column:
    """13 to 19 digits, after dropping all else, that pass the check."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\D", ""))


def urgency(span_type: Column, category: Column) -> Column:
    flag = F.when(category.isin(*vocab.CRITICAL_FLAGS), "critical").otherwise("elevated")
    span = F.when(category.isin(*vocab.CRITICAL_SPANS), "critical").when(category.isin(*vocab.ELEVATED_SPANS), "elevated").otherwise("standard")
    return F.when(span_type == "risk_flag", flag).otherwise(span)


def infer_category(text: Column) -> Column:
    """The category whose expression a text matches first."""
    t = strip(text)
    out = F.lit("TEXT")
    for regex, name in reversed(vocab.INFERRED):
        out = F.when(t.rlike(regex), name).otherwise(out)
    return out


def label(category: Column, text: Column) -> Column:
    """The category in capitals, with its first underscore a space; inferred from the text if there is none."""
    upper = F.upper(category)
    return F.when(category.isNull(), infer_category(text)).otherwise(F.regexp_replace(upper, r"^([^_]*)_", "$1 "))


def confidence_bucket(score: Column, manual: Column) -> Column:
    return F.when(~manual, F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low"))


def provenance(manual: Column, agreement: Column, sources: Column) -> Column:
    first = F.coalesce(F.get(sources, F.lit(0)), F.lit("regex"))
    return F.when(manual, "manual").when(agreement > 1, F.concat(F.lit("verified by "), agreement.cast("string"))).otherwise(F.concat(F.lit("caught by "), first))


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
