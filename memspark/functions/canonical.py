"""Stable JSON text and the keys derived from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions import jsjson

# JSON text that Spark's VARIANT prints differently from
# JavaScript. A match only costs time, so the patterns are generous.
# Each alternative starts at a digit, which text seldom has.
UNUSUAL_NUMBER = (
    r"[0-9](?<=(?:^|[:\[,\s-])[0-9])(?:"
    r"[0-9.]*[eE][+-]?[0-9]"  # exponent
    r"|[0-9.]{15}"  # more digits than a double holds
    r"|\.000000)"  # printed with an exponent
)
UNUSUAL_ESCAPE = (
    r"\\(?:u00[01]"  # control character
    r"|\\u"  # hides what the next two alternatives look for
    r"|u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"  # high surrogate alone
    r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2}\\)u[dD][c-fC-F])"  # low surrogate alone
)


def unusual(raw: Column) -> Column:
    escapes = F.contains(raw, F.lit("\\u")) & raw.rlike(UNUSUAL_ESCAPE)
    return raw.rlike(UNUSUAL_NUMBER) | escapes


def _exact_text(field: str | None):
    """Arrow UDF: canonical text of a document, or of one field of it."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = jsjson.parse(text)
        except ValueError:
            return None
        if field is None:
            return jsjson.stable_text(value)
        if not isinstance(value, dict) or field not in value:
            return None
        return jsjson.stable_text(value[field])

    @F.pandas_udf(T.StringType())
    def exact(texts: pd.Series) -> pd.Series:
        if texts.isna().all():
            return texts
        return texts.map(one, na_action="ignore")

    return exact


def canonical_json(raw: Column, doc: Column | None = None, field: str | None = None) -> Column:
    """Canonical text of the JSON in ``raw``, or of its top-level ``field``.

    ``doc`` is ``raw`` already parsed. The built-in VARIANT printer does nearly
    all rows. Only the unusual ones are handed to Python; for the others the
    UDF receives NULL, which costs little next to reading the input twice. Texts
    that do not parse here are handed over too: they may hold a key twice, which
    the built-in parser refuses unless the session says otherwise. The last one counts.
    """
    by_hand = unusual(raw)
    if doc is None:
        doc = F.try_parse_json(raw)
        by_hand = by_hand | doc.isNull()
    value = doc if field is None else F.try_variant_get(doc, f"$.{field}", "variant")
    exact = _exact_text(field)(F.when(by_hand, raw))
    return F.coalesce(exact, F.to_json(value))


def canonical_json_builtin(raw: Column) -> Column:
    """Canonical text without any Python, for input known to hold plain numbers and escapes."""
    return F.to_json(F.try_parse_json(raw))


def content_hash_hex(type_: Column, source: Column, content: Column) -> Column:
    """NULL when a part is NULL: a hash without one of its parts would join unlike records."""
    return F.sha2(F.concat(type_, F.lit("::"), source, F.lit("::"), content), 256)


def content_hash(type_: Column, source: Column, content: Column) -> Column:
    """SHA-256 of ``type::source::canonical content``; tags and confidence are left out."""
    return F.unhex(content_hash_hex(type_, source, content))


def id_from_hash(digest: Column) -> Column:
    """A UUID made of the first half of the hash, so that a retried task gives the same id."""
    # One pattern, so that the hash appears, and is worked out, only once.
    return F.regexp_replace(F.lower(F.hex(digest)), r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*\z", "$1-$2-$3-$4-$5")


def embedding_key(text: Column, model: str) -> Column:
    return F.concat(F.sha2(text, 256), F.lit("::"), F.lit(model))
