"""Checks and clean-up of requests: every row ends up valid or with its first error.

All checks work on the VARIANT of the request, because they depend on the JSON
type: ``"0.5"`` is not a number and ``tags: null`` is not the same as no tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.bind import let
from memspark.functions.canonical import canonical_json
from memspark.functions.text import TAG_PATTERN, UUID_PATTERN, js_number, js_trim, longer_than
from memspark.options import QUERY_LENGTH, SOURCE_LENGTH, TYPE_LENGTH, Options
from memspark.sources.requests import MALFORMED, MALFORMED_LENGTH

NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"

# The error texts.
TYPE_REQUIRED = "type is required and must be a non-empty string"
TYPE_BLANK = "type must be a non-empty string"
CONTENT_REQUIRED = "content is required"
SOURCE_REQUIRED = "source is required and must be a non-empty string"
CONFIDENCE_REQUIRED = "confidence is required and must be a number between 0 and 1"
TAGS_NOT_ARRAY = "tags must be an array"
TAGS_TOO_MANY = "tags array cannot have more than {} items"
TAG_INVALID = 'invalid tag: "{}"'
CONTENT_TOO_LARGE = "content is too large (max {} characters)"
QUERY_REQUIRED = "query is required and must be a non-empty string"
QUERY_TOO_LONG = "query length cannot exceed 1000 characters"
LIMIT_NOT_POSITIVE = "limit must be a positive number"
LIMIT_FRACTION = "limit must be a whole number"
ID_REQUIRED = "id is required and must be a non-empty string"
ID_INVALID = "id must be a valid UUID format"


def _fields(parsed: DataFrame, *names: str) -> DataFrame:
    """Add per field: ``name`` (VARIANT) and ``name_is`` (its JSON type, NULL when missing)."""
    parts = {n: F.try_variant_get("doc", f"$.{n}", "variant") for n in names}
    kinds = {f"{n}_is": F.schema_of_variant(n) for n in names}
    return parsed.withColumns(parts).withColumns(kinds)


def _string(name: str) -> Column:
    """The field as text when it is a JSON string, else NULL."""
    return F.when(F.col(f"{name}_is") == "STRING", F.try_variant_get(name, "$", "string"))


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _falsy(name: str) -> Column:
    """Missing, null, false, zero or the empty string."""
    text = F.to_json(name)
    return F.col(f"{name}_is").isNull() | text.isin("null", "false", "0", "0.0", '""')


def _tag_text(tag: Column) -> Column:
    """A tag as JavaScript turns it into text; NULL for arrays and objects, which are refused."""
    return let(
        F.schema_of_variant(tag),
        lambda kind: F.when(kind == "STRING", F.try_variant_get(tag, "$", "string"))
        .when(kind == "VOID", F.lit("null"))
        .when(kind == "BOOLEAN", F.to_json(tag))
        .when(kind.rlike(NUMERIC), js_number(F.try_variant_get(tag, "$", "double"))),
    )


def _tags(df: DataFrame) -> DataFrame:
    """Add ``tag_list``: struct of the raw text and the cleaned tag, NULL unless ``tags`` is an array."""
    items = F.try_variant_get("tags", "$", "array<variant>")
    texts = F.transform(items, lambda tag: F.struct(_tag_text(tag).alias("text"), F.to_json(tag).alias("json")))
    pairs = F.transform(
        texts,
        lambda tag: F.struct(
            F.coalesce(tag["text"], tag["json"]).alias("raw"), F.lower(js_trim(tag["text"])).alias("clean")
        ),
    )
    return df.withColumn("tag_list", F.when(F.col("tags_is").startswith("ARRAY"), pairs))


def _bad_tag(tag_list: Column) -> Column:
    """Raw text of the first tag that does not fit the pattern."""
    bad = F.filter(tag_list, lambda t: ~F.coalesce(t["clean"].rlike(TAG_PATTERN), F.lit(False)))
    return F.get(bad, F.lit(0))["raw"]


def _clean_tags(tag_list: Column) -> Column:
    return F.transform(tag_list, lambda t: t["clean"])


def _message(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _first_error(*checks: tuple[Column, str | Column]) -> Column:
    """Text of the first check that fails; a check whose condition is NULL does not fail."""
    malformed = (F.col("doc").isNull(), F.lit(MALFORMED))
    return F.coalesce(
        *[F.when(failed, text if isinstance(text, Column) else F.lit(text)) for failed, text in (malformed, *checks)]
    )


def outcome(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The kept columns and the outcome, worked out once per row.

    ``inline`` keeps later filters on ``error`` above this step. As plain
    columns, the optimizer would copy all checks into such a filter and run
    them twice.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def check_creates(parsed: DataFrame, options: Options = Options()) -> DataFrame:
    """Create requests with their cleaned fields and ``error`` (NULL when valid).

    Adds type, content (canonical text), source, tags, confidence and error to
    the columns of ``parsed`` (raw, doc and any others).
    """
    extra = [name for name in parsed.columns if name != "doc"]
    df = _tags(_fields(parsed, "type", "source", "confidence", "tags"))
    df = df.withColumns(
        {
            "type_text": js_trim(_string("type")),
            "source_text": js_trim(_string("source")),
            "confidence_value": F.when(
                F.col("confidence_is").rlike(NUMERIC), F.try_variant_get("confidence", "$", "double")
            ),
            "content_null": F.coalesce(
                F.is_variant_null(F.try_variant_get("doc", "$.content", "variant")), F.lit(True)
            ),
            "content": canonical_json(F.col("raw"), F.col("doc"), "content"),
        }
    )
    content, tag_list, confidence = F.col("content"), F.col("tag_list"), F.col("confidence_value")
    df = df.withColumn("bad_tag", _bad_tag(tag_list))
    error = _first_error(
        (_blank(F.col("type_text")), TYPE_REQUIRED),
        (content.isNull() | F.col("content_null") | content.isin("false", "0", '""'), CONTENT_REQUIRED),
        (_blank(F.col("source_text")), SOURCE_REQUIRED),
        (~F.coalesce(confidence.between(0, 1), F.lit(False)), CONFIDENCE_REQUIRED),
        (F.col("tags_is").isNotNull() & ~F.col("tags_is").startswith("ARRAY"), TAGS_NOT_ARRAY),
        (F.size(tag_list) > options.max_tags, TAGS_TOO_MANY.format(options.max_tags)),
        (
            longer_than(content, options.max_content_length),
            CONTENT_TOO_LARGE.format(options.max_content_length),
        ),
        (F.col("bad_tag").isNotNull(), _message(TAG_INVALID, F.col("bad_tag"))),
    )
    return outcome(
        df,
        extra,
        error=error,
        type=F.substring("type_text", 1, TYPE_LENGTH),
        content=content,
        source=F.substring("source_text", 1, SOURCE_LENGTH),
        tags=F.coalesce(F.array_distinct(_clean_tags(tag_list)), F.array().cast("array<string>")),
        confidence=confidence,
    )


def _filters(df: DataFrame) -> DataFrame:
    """Add the cleaned optional filters: a falsy value means that there is none."""
    return df.withColumns(
        {
            "type_given": ~_falsy("type"),
            "type_text": F.coalesce(js_trim(_string("type")), F.lit("")),
            "tags_given": ~_falsy("tags"),
            "bad_tag": _bad_tag(F.col("tag_list")),
        }
    )


def _filter_errors(type_text: str) -> list[tuple[Column, str | Column]]:
    given = F.col("tags_given")
    return [
        (F.col("type_given") & (F.col("type_text") == ""), type_text),
        (given & ~F.col("tags_is").startswith("ARRAY"), TAGS_NOT_ARRAY),
        (F.col("bad_tag").isNotNull(), _message(TAG_INVALID, F.col("bad_tag"))),
    ]


def _filter_columns() -> dict[str, Column]:
    return {
        "type": F.when(F.col("type_given"), F.substring("type_text", 1, TYPE_LENGTH)),
        "tags": F.when(F.col("tags_given"), _clean_tags(F.col("tag_list"))),
    }


def check_searches(parsed: DataFrame, options: Options = Options()) -> DataFrame:
    """Search requests with query, type, tags, limit and error."""
    extra = [name for name in parsed.columns if name != "doc"]
    df = _filters(_tags(_fields(parsed, "query", "type", "tags", "limit")))
    number = F.when(F.col("limit_is").rlike(NUMERIC), F.try_variant_get("limit", "$", "double"))
    df = df.withColumns({"query_raw": _string("query"), "limit_number": number})
    df = df.withColumn("query_text", js_trim(F.col("query_raw")))
    # ``least`` skips NULL, but a missing limit must stay NULL here.
    asked = F.when(F.col("limit_number").isNotNull(), F.least("limit_number", F.lit(float(options.max_limit))))
    error = _first_error(
        (_blank(F.col("query_text")), QUERY_REQUIRED),
        (longer_than(F.col("query_raw"), QUERY_LENGTH), QUERY_TOO_LONG),
        (
            F.col("limit_is").isNotNull() & ~F.coalesce(F.col("limit_number") >= 1, F.lit(False)),
            LIMIT_NOT_POSITIVE,
        ),
        (asked != F.floor(asked), LIMIT_FRACTION),
        *_filter_errors(TYPE_REQUIRED),
    )
    limit = F.coalesce(asked, F.lit(float(options.default_limit))).cast("int")
    return outcome(df, extra, error=error, query=F.col("query_text"), **_filter_columns(), limit=limit)


def check_lists(parsed: DataFrame) -> DataFrame:
    """List requests with type, tags and error."""
    extra = [name for name in parsed.columns if name != "doc"]
    df = _filters(_tags(_fields(parsed, "type", "tags")))
    return outcome(df, extra, error=_first_error(*_filter_errors(TYPE_BLANK)), **_filter_columns())


def check_ids(requests: DataFrame, id_column: str = "id") -> DataFrame:
    """Id requests (a text column) with the trimmed id and error."""
    asked = F.col(id_column)
    error = F.coalesce(
        F.when(_blank(asked), F.lit(ID_REQUIRED)), F.when(~asked.rlike(UUID_PATTERN), F.lit(ID_INVALID))
    )
    kept = [name for name in requests.columns if name != id_column]
    trimmed = requests.withColumn(id_column, js_trim(asked))
    return outcome(trimmed, kept, **{id_column: asked, "error": error})


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).drop("error", "raw")


def rejects(checked: DataFrame) -> DataFrame:
    """Reject rows; a malformed line is cut to its first characters."""
    raw = F.when(F.col("error") == MALFORMED, F.substring("raw", 1, MALFORMED_LENGTH)).otherwise(F.col("raw"))
    return checked.filter(F.col("error").isNotNull()).select(raw.alias("raw"), "error")
