"""Listing newest first, the newest few, fetching by id, and many such requests at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import SPACE, SPACES, js_trim
from memspark.operators.filters import matching
from memspark.operators.skew import join_salted, join_sized
from memspark.operators.validate import check_ids, outcome
from memspark.options import BROWSE_LIMIT, BROWSE_MAX, BROWSE_MIN
from memspark.sources.scratch import Workspace

LIST_ROW = ["id", "type", "tags", "confidence", "created_at", "updated_at"]
ENTRY = ["key", "id", "created_at"]  # of a record in a list
FULL_ROW = ["id", "type", "content", "source", "tags", "confidence", "created_at", "updated_at"]

# Fixed value: error text of an id that no record has.
NOT_FOUND = "Memory not found: "


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.col("id")]


def listed(memories: DataFrame, type: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """All matching records, newest first."""
    return matching(memories, type, tags).select(*LIST_ROW).orderBy(*newest_first())


def browse_limit(limit: int | None = None) -> int:
    """The number of rows to show: 20 when not given, moved into 1 to 100."""
    return BROWSE_LIMIT if limit is None else max(BROWSE_MIN, min(BROWSE_MAX, int(limit)))


def recent(memories: DataFrame, limit: int | None = None) -> DataFrame:
    return listed(memories).limit(browse_limit(limit))


def recent_by_type(memories: DataFrame, type: str, limit: int | None = None) -> DataFrame:
    """Newest records of a type, which is compared as given."""
    return listed(memories, type=type).limit(browse_limit(limit))


def split_tags(text: str) -> list[str]:
    """Comma-separated tags, trimmed but not lower-cased or checked; empty ones are dropped."""
    return [tag for tag in (part.strip(SPACES) for part in text.split(",")) if tag]


def recent_by_tags(memories: DataFrame, tags: str, limit: int | None = None) -> DataFrame:
    """Newest records that have any of the comma-separated tags."""
    return listed(memories, tags=split_tags(tags)).limit(browse_limit(limit))


def get_by_id(memories: DataFrame, id: str) -> DataFrame:
    """The full record with an id, which is compared in lower case; the comparison reaches the scan."""
    return memories.filter(F.col("id") == F.lit(id.strip(SPACES).lower())).select(*FULL_ROW)


def get_by_ids(
    memories: DataFrame,
    requests: DataFrame,
    request_id: str = "request_id",
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per id request: the full record, or the error.

    ``requests`` has a unique ``request_id`` and the wanted ``id``. Each id is
    looked up once; the records are then spread over the requests, and an id
    whose answers take many bytes is spread over many tasks. The checked
    requests are staged, since counting and answering both read them. ``memories``
    are read twice, first for the lengths of the wanted records.
    """
    workspace = workspace or Workspace(requests.sparkSession)
    checked = check_ids(requests.select(request_id, F.col("id").alias("asked")), "asked")
    checked = workspace.stage(checked, "ids")
    good = checked.filter(F.col("error").isNull()).select(request_id, "asked")
    answered = _with_records(memories, good, request_id, workspace).withColumn(
        "error", F.when(F.col("id").isNull(), F.concat(F.lit(NOT_FOUND), F.col("asked")))
    )
    refused = checked.filter(F.col("error").isNotNull()).select(request_id, "error")
    return answered.unionByName(refused, allowMissingColumns=True).select(request_id, *FULL_ROW, "error")


def _with_records(memories: DataFrame, asked: DataFrame, request_id: str, workspace: Workspace) -> DataFrame:
    """``asked`` (request_id, asked) with the record of each id, NULL where there is none."""
    keyed = asked.withColumn("key", F.lower("asked"))
    wanted = keyed.groupBy("key").agg(F.count("*").alias("n"))
    found = memories.select(*FULL_ROW, F.col("id").alias("key")).join(wanted.select("key"), "key", "left_semi")
    lengths = found.groupBy("key").agg(F.sum(_bytes(memories)).alias("bytes"))
    sizes = wanted.join(lengths, "key", "left").select("key", "n", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return join_sized(keyed, found, "key", workspace.stage(sizes, "sizes"), [request_id]).drop("key")


def _bytes(memories: DataFrame) -> Column:
    """The bytes of a record's long fields, about. Tags may be a list or one text."""
    tags = F.col("tags") if memories.schema["tags"].dataType.typeName() == "string" else F.array_join("tags", ",")
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("content", tags)), F.lit(0)).cast("long")


SHELF_PARTS = 64

# The address forms of the read-only views.
ADDRESS = r"^mem://([^/?#]+)(/[^?#]*)?(?:\?([^#]*))?"
UNKNOWN_ADDRESS = "Unknown resource: "


def parse_addresses(requests: DataFrame, address: str = "uri") -> DataFrame:
    """Split ``mem://…`` addresses into view, argument, limit and error.

    Views are recent, by-tags, by-type and item. A plus sign stays a plus sign
    in the argument, as percent-decoding of a path leaves it.
    """
    uri, view, path = F.col(address), F.col("__view"), F.col("__path")
    # the first limit counts
    limit_text = F.try_url_decode(F.regexp_extract(uri, r"^[^?#]*\?(?:[^#]*?&)??limit(?:=([^&#]*))?(?=&|#|\z)", 1))
    split = requests.withColumns(
        {
            "__view": F.regexp_extract(uri, ADDRESS, 1),
            "__path": F.regexp_extract(uri, ADDRESS, 2),
            "__has_limit": uri.rlike(r"^[^?#]*\?(?:[^#]*&)?limit(?:=|&|#|\z)"),
            "__number": F.regexp_extract(limit_text, rf"^{SPACE}*([+-]?\d+)", 1),
        }
    )
    raw = F.regexp_extract(uri, r"^mem://[^/?#]+/([^?#]*)", 1)
    split = split.withColumn("__text", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
    decoded, has_limit, number = F.col("__text"), F.col("__has_limit"), F.col("__number")
    known = ((view == "recent") & (path == "")) | (view.isin("by-tags", "by-type", "item") & (path != ""))
    limit = F.when(~has_limit, F.lit(BROWSE_LIMIT)).otherwise(
        F.greatest(F.lit(float(BROWSE_MIN)), F.least(F.lit(float(BROWSE_MAX)), number.try_cast("double"))).cast("int")
    )
    error = F.coalesce(
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit(UNKNOWN_ADDRESS), F.coalesce(uri, F.lit("")))),
        F.when(has_limit & (number == ""), F.lit("limit must be a number")),
        F.when((view != "item") & (path != "") & decoded.isNull(), F.lit("URI malformed")),
    )
    argument = F.when(view == "item", raw).when(view == "recent", F.lit("")).otherwise(decoded)
    return outcome(split, requests.columns, view=view, argument=argument, limit=limit, error=error)


def _fixed_shelves() -> Column:
    """The lists a record stands in whatever its tags: all records, its type."""
    return F.array(F.lit("all:"), F.concat(F.lit("type:"), "type"))


def _tag_shelves() -> Column:
    tags = F.transform(F.array_distinct("tags"), lambda tag: F.concat(F.lit("tag:"), tag))
    return F.coalesce(tags, F.array().cast("array<string>"))


def _newest_by_shelf(rows: DataFrame) -> DataFrame:
    """The newest BROWSE_MAX rows per shelf with their ``rank``, ranked in parts first: no list meets in one task."""
    part = Window.partitionBy("shelf", "__part").orderBy(*newest_first())
    best = rows.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(SHELF_PARTS)))
    best = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= BROWSE_MAX).drop("rank", "__part")
    shelf = Window.partitionBy("shelf").orderBy(*newest_first())
    return best.withColumn("rank", F.row_number().over(shelf)).filter(F.col("rank") <= BROWSE_MAX)


def _wanted_shelves() -> Column:
    """The lists an address asks for. An empty type or tag list filters nothing, so it asks for all."""
    names = F.filter(F.transform(F.split("argument", ","), js_trim), lambda tag: tag != "")
    tags = F.transform(F.array_distinct(names), lambda tag: F.concat(F.lit("tag:"), tag))
    return (
        F.when((F.col("view") == "by-tags") & (F.size(tags) > 0), tags)
        .when((F.col("view") == "by-type") & (F.col("argument") != ""), F.array(F.concat(F.lit("type:"), "argument")))
        .otherwise(F.array(F.lit("all:")))
    )


def browse_many(
    memories: DataFrame,
    addresses: DataFrame,
    request_id: str = "request_id",
    workspace: Workspace | None = None,
) -> DataFrame:
    """Answer a table of list addresses (recent, by-tags, by-type) in one pass over the memories.

    No view shows more than the newest 100 rows, so the newest 100 of every
    wanted type and tag hold every answer. Each task keeps only its own newest
    rows of a list before the shuffle. The lists are then joined with the
    requests, each of which takes its own number of rows, and only these rows get the
    tags of their record. Faulty addresses have no
    rows here; ``refused`` gives their errors.
    """
    workspace = workspace or Workspace(addresses.sparkSession)
    asked = workspace.stage(asked_lists(addresses, request_id), "asked")
    return answered(memories, asked, request_id, workspace)


def asked_lists(addresses: DataFrame, request_id: str) -> DataFrame:
    """(request_id, limit, shelf): one row for every list that a faultless address asks for."""
    asked = parse_addresses(addresses).filter(F.col("error").isNull() & (F.col("view") != "item"))
    return asked.select(request_id, "limit", F.explode(_wanted_shelves()).alias("shelf"))


def keyed_records(memories: DataFrame, workspace: Workspace) -> DataFrame:
    """The LIST_ROW of every record with a ``key`` of its own (ids may repeat), staged. Lists hold ENTRY only: a
    record stands in a list for each of its tags, and would bring all of them to every one."""
    return workspace.stage(memories.select(F.monotonically_increasing_id().alias("key"), *LIST_ROW), "records")


def answered(memories: DataFrame, asked: DataFrame, request_id: str, workspace: Workspace) -> DataFrame:
    """The rows for ``asked`` (staged) from the records themselves."""
    counts = asked.groupBy("shelf").agg(F.count("*").alias("n"))
    records = keyed_records(memories, workspace)

    # Lists of all records and of a type are cut before the join, as few rows of them are left;
    # tags may be very many, so only the wanted ones are ranked.
    rows = records.select(*ENTRY, F.explode(_fixed_shelves()).alias("shelf"))
    fixed = _newest_by_shelf(rows).join(counts.select("shelf"), "shelf", "left_semi")
    tagged = records.select(*ENTRY, F.explode(_tag_shelves()).alias("shelf"))
    tagged = _newest_by_shelf(tagged.join(counts.select("shelf"), "shelf", "left_semi"))
    newest = workspace.stage(fixed.unionByName(tagged), "newest")
    return hits(asked, newest, counts, records, request_id, workspace)


def hits(
    asked: DataFrame, newest: DataFrame, counts: DataFrame, records: DataFrame, request_id: str, workspace: Workspace
) -> DataFrame:
    """Each request takes its own number of rows of the lists it asks for (ENTRY, shelf, rank); the other fields
    come from ``records`` (key, LIST_ROW) at the end."""
    # A record with several of the wanted tags comes up once per tag: keep one.
    met = (
        join_salted(asked, newest, "shelf", counts, [request_id], how="inner")
        .filter(F.col("rank") <= F.col("limit"))
        .drop("shelf", "rank")
        .dropDuplicates([request_id, "id"])
    )
    met = workspace.stage(met, "met")
    window = Window.partitionBy(request_id).orderBy(*newest_first())
    placed = (
        met.withColumn("rank", F.row_number().over(window))
        .filter((F.col("rank") <= BROWSE_MAX) & (F.col("rank") <= F.col("limit")))
        .select(request_id, "rank", *ENTRY)
    )
    shown = met.groupBy("key").agg(F.count("*").alias("n"))
    found = records.drop("id", "created_at").join(shown.select("key"), "key", "left_semi")
    return join_salted(placed, found, "key", shown, [request_id], how="inner").select(request_id, "rank", *LIST_ROW)


def refused(addresses: DataFrame, request_id: str = "request_id") -> DataFrame:
    """(request_id, error) of the addresses that have no answer because they are faulty."""
    return parse_addresses(addresses).filter(F.col("error").isNotNull()).select(request_id, "error")


def items_by_address(
    memories: DataFrame,
    addresses: DataFrame,
    request_id: str = "request_id",
    workspace: Workspace | None = None,
) -> DataFrame:
    """Answer the item addresses of a table: one row per address, all NULL when no record has the id.
    Faulty addresses are left to ``refused``."""
    workspace = workspace or Workspace(addresses.sparkSession)
    asked = parse_addresses(addresses).filter(F.col("error").isNull() & (F.col("view") == "item"))
    asked = workspace.stage(asked.select(request_id, F.col("argument").alias("asked")), "items")
    return _with_records(memories, asked, request_id, workspace).select(request_id, *FULL_ROW)
