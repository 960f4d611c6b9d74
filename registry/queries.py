"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark import Options
from memspark.functions.canonical import (
    canonical_json,
    canonical_json_builtin,
    content_hash_hex,
    embedding_key,
)
from memspark.functions.lexemes import lexemes as lexemes_of
from memspark.functions.vectors import l2_normalize, mean_pool, width_ok
from memspark.operators import browse, grouped, merge, shape
from memspark.operators import known as known_hashes_of
from memspark.operators.embed import HashingEmbedder, distinct_texts, embed_once
from memspark.operators.filters import matching
from memspark.operators.newest import browse_table
from memspark.operators.search import search, search_many
from memspark.operators.validate import check_creates, check_lists, check_searches
from memspark.plans.backlog import Retry
from memspark.plans.create import create
from memspark.plans.lists import run_lists
from memspark.plans.search import run_searches
from memspark.sources.requests import parse_lines, read_lines_stream
from memspark.sources.results import json_rows
from memspark.sources.scratch import Workspace
from memspark.sources.table import MemoryTable
from memspark.streaming.dedupe import latest, stream_fold, write_changes
from memspark.streaming.ingest import ingest_stream
from memspark.streaming.keyed import fold_changes, keyed_fold, last_changes
from registry import views as V
from registry.embedders import Crooked, Down, FirstTimeFailing
from registry.views import DIM, flat, table

OPTIONS = Options(dim=DIM)


# -- validation -------------------------------------------------------------


def validate_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_creates(parse_lines(V.document_lines(spark, sf_dir)))
    fields = {
        "type": F.col("type"),
        "content_hash": content_hash_hex(F.col("type"), F.col("source"), F.col("content")),
        "source": F.col("source"),
        "tags": F.array_join("tags", ","),
        "confidence": F.col("confidence"),
    }
    return checked.select(
        F.col("seq").alias("doc_id"),
        "error",
        *[F.when(F.col("error").isNull(), value).alias(name) for name, value in fields.items()],
    )


def rejects_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_creates(parse_lines(V.document_lines(spark, sf_dir)))
    return checked.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n"))


def validate_edge_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that count as missing, tags of the wrong form and number, type and source beyond their length."""
    kind = F.col("doc_id") % 8
    rest = F.lit(',"source":"s","confidence":0.5')
    raw = F.concat(
        F.lit('{"type":"'),
        F.when(kind == 7, F.repeat(F.lit("t"), F.lit(60))).otherwise("t"),
        F.lit('"'),
        F.when(kind == 0, "").when(kind == 1, ',"content":null').when(kind == 2, ',"content":false').when(kind == 3, ',"content":0')
        .when(kind == 4, ',"content":""').when(kind == 7, ',"content":[]').otherwise(',"content":"x"'),
        F.when(kind == 7, F.concat(F.lit(',"source":"'), F.repeat(F.lit("s"), F.lit(120)), F.lit('","confidence":0.5'))).otherwise(rest),
        F.when(kind == 5, ',"tags":"a"').when(kind == 6, ',"tags":["a"' + ',"a"' * 20 + "]").otherwise(""),
        F.lit("}"),
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    checked = check_creates(parse_lines(lines))
    valid = F.col("error").isNull()
    lengths = {f"{c}_length": F.when(valid, F.char_length(c)) for c in ("type", "source")}
    return checked.select("doc_id", "error", *[v.alias(k) for k, v in lengths.items()])


def validate_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    limit = (
        F.when(lang == "en", F.col("n_chars").cast("string"))
        .when(lang == "de", (F.col("n_chars") / 4).cast("string"))
        .when(lang == "es", F.concat(F.lit('"'), F.col("n_chars").cast("string"), F.lit('"')))
    )
    raw = F.concat(
        F.lit('{"query":'),
        F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":|\}\z', ""),
        F.coalesce(F.concat(F.lit(',"limit":'), limit), F.lit("")),
        F.lit(',"type":"'),
        F.when(F.col("source") == "src0", "").otherwise(F.concat(F.lit(" "), "lang")),
        F.lit('","tags":["'),
        F.concat_ws('","', F.upper("source"), "source"),
        F.lit('"]}'),
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    checked = check_searches(parse_lines(lines))
    fields = {
        "query_key": F.sha2("query", 256),
        "type": F.col("type"),
        "tags": F.array_join("tags", ","),
        "limit_rows": F.col("limit"),
    }
    return checked.select(
        "doc_id", "error", *[F.when(F.col("error").isNull(), v).alias(n) for n, v in fields.items()]
    )


def validate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    type_ = F.when(lang == "en", '"en\\u00a0"').when(lang == "fr", '""').when(lang == "de", '"  "').otherwise("5")
    tags = (
        F.when(F.col("source") == "src1", "null")
        .when(F.col("source") == "src2", '"src2"')
        .when(F.col("source") == "src3", '["src3",null,3]')
        .when(F.col("source") == "src4", '["Src 4"]')
        .otherwise(F.concat(F.lit('["'), "source", F.lit('"]')))
    )
    raw = F.concat(F.lit('{"type":'), type_, F.lit(',"tags":'), tags, F.lit("}"))
    checked = check_lists(parse_lines(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))))
    return checked.select(
        "doc_id",
        "error",
        F.when(F.col("error").isNull(), F.col("type")).alias("type"),
        F.when(F.col("error").isNull(), F.array_join("tags", ",")).alias("tags"),
    )


# -- canonical text and derived columns ---------------------------------------


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    digest = content_hash_hex(F.col("event_type"), F.lit("app"), canonical_json(F.col("props")))
    return events.select("event_id", digest.alias("content_hash"))


def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as JSON with the fields in the wrong order; the hash is that of the sorted text."""
    raw = F.to_json(F.struct("url", "html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(canonical_json(raw), 256).alias("text_key"))


def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with and without exponents, in JavaScript form."""
    raw = F.to_json(
        F.struct(
            (F.col("o_totalprice") / 1e12).alias("tiny"),
            F.col("o_totalprice").alias("price"),
            (F.col("o_orderkey") * F.lit(1e3)).alias("key"),
        )
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical_json(raw).alias("text"))


def lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.document_texts(spark, sf_dir)
    rows = docs.select("doc_id", F.inline(lexemes_of(F.col("content"), F.col("source"))))
    return rows.select("doc_id", "lexeme", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def lexemes_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search words that the table of documents stores."""
    rows = _document_table(spark, sf_dir, Workspace(spark)).read(columns=["id", "lexemes"]).select("id", F.inline("lexemes"))
    return rows.select("id", "lexeme", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def embed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", embedding_key(F.col("text"), "model").alias("embed_key"))


# -- embedding ----------------------------------------------------------------


def embed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_texts(table(spark, sf_dir, "documents"), "text", "model").select("embed_key", "n")


def embed_once_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the vector of its text; equal texts share one model run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    embedded = embed_once(docs, "text", HashingEmbedder(DIM), OPTIONS, spread_by=["doc_id"])
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x * x))
    weighed = F.transform(numbers, lambda x, i: x * (i + 1))
    moment = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x)
    return embedded.select(
        "doc_id",
        "embed_error",
        F.size("embedding").alias("width"),
        F.round(length, 3).alias("length"),
        (F.round(moment, 3) + F.lit(0.0)).alias("moment"),
    )


def embed_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is embedded although the model fails whenever it meets a text for the first time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    embedded = embed_once(docs, "text", FirstTimeFailing(DIM), OPTIONS, spread_by=["doc_id"], pause=0.0)
    return embedded.select("doc_id", F.size("embedding").alias("width"), "embed_error")


def reject_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the vector of a text cannot be stored: no vector, a wrong width, NaN or infinity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    options = Options(dim=DIM, embed_retries=1)
    embedded = embed_once(docs, "text", Crooked(DIM), options, spread_by=["doc_id"], pause=0.0, batch=16)
    return embedded.select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"), "embed_error")


def embed_cls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First word only, not normalised: one entry per document that has a word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    options = Options(dim=DIM, pooling="cls", normalize=False)
    embedded = embed_once(docs, "text", HashingEmbedder(DIM), options, spread_by=["doc_id"])
    entries = embedded.select("doc_id", F.posexplode("embedding").alias("place", "x")).filter("x != 0")
    return entries.select("doc_id", "place", F.col("x").cast("double"))


def mean_pool_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    unit = pooled.select("label", l2_normalize(F.col("embedding")).alias("v"))
    return unit.select("label", F.posexplode("v").alias("pos", "x")).select(
        "label", "pos", (F.round("x", 6) + F.lit(0.0)).alias("x")
    )


def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", width_ok(F.col("embedding"), DIM).alias("ok"))


# -- upsert ---------------------------------------------------------------------

RECORD = ["content_hash", "id", "type", "content", "source", "tags", "confidence", "created_at", "updated_at"]


def upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(V.event_records(spark, sf_dir).select(*RECORD))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    low = F.coalesce(F.col("value") < 50, F.lit(False))
    return V.event_writes(events.filter(low)), V.event_writes(events.filter(~low))


def upsert_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in two batches: one already compacted, one pending."""
    first, second = _halves(spark, sf_dir)
    vector = F.array().cast("array<float>")
    memories = MemoryTable.create(spark, Workspace(spark).path("table"), 0, "none")
    memories.append(merge.fold(first.withColumn("embedding", vector), hashed=True), "events", 0)
    memories.compact()
    memories.append(merge.fold(second.withColumn("embedding", vector), hashed=True), "events", 1)
    rows = memories.read().select(*RECORD)
    return flat(rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("created_at", "updated_at")}))


def _event_table(spark: SparkSession, sf_dir: str, workspace: Workspace) -> MemoryTable:
    """The events of small value folded into the base, the others pending."""
    first, second = (merge.fold(half.withColumn("embedding", F.array().cast("array<float>")), hashed=True) for half in _halves(spark, sf_dir))
    memories = MemoryTable.create(spark, workspace.path("table"), 0, "none")
    memories.append(first, workspace=workspace)
    memories.compact()
    memories.append(second, workspace=workspace)
    return memories


def compact_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in two batches, the second of which is folded into half of the buckets only; ``rewritten`` tells whether
    the fold rewrote the record's bucket."""
    memories = _event_table(spark, sf_dir, Workspace(spark))
    before = memories.state().base
    memories.compact(buckets=range(memories.buckets // 2))
    after = memories.state().base
    changed = [b for b in after if after[b] != before.get(b)]
    bucket = known_hashes_of.bucket_of(F.col("content_hash"), memories.buckets)
    rows = memories.read().select(*RECORD, bucket.isin(changed).alias("rewritten"))
    return flat(rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("created_at", "updated_at")}))


def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of all events: is it stored, when only the events of small value were written?"""
    workspace = Workspace(spark)
    first, _ = _halves(spark, sf_dir)
    memories = MemoryTable.create(spark, workspace.path("table"), 0, "none")
    memories.append(merge.fold(first, hashed=True).withColumn("embedding", F.array().cast("array<float>")), workspace=workspace)
    records = workspace.stage(V.event_records(spark, sf_dir), "records")
    stored = memories.known(records, workspace).stored
    hashes = records.select("content_hash")
    if stored is None:
        return flat(hashes.withColumn("stored", F.lit(False)))
    return flat(hashes.join(stored.select("content_hash", F.lit(True).alias("s")), "content_hash", "left").select("content_hash", F.coalesce("s", F.lit(False)).alias("stored")))


def browse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of ``browse_many`` answered from the kept lists of the base and a pending batch."""
    workspace = Workspace(spark)
    memories = _event_table(spark, sf_dir, workspace)
    found = browse_table(memories, _event_addresses(spark, sf_dir), workspace=workspace)
    return found.select("request_id", "rank", "id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to split the same hashed text into type and source: the earlier write names the record."""
    even = F.col("event_id") % 2 == 0
    writes = table(spark, sf_dir, "events").select(
        F.when(even, "a::b").otherwise("a").alias("type"),
        F.when(even, "c").otherwise("b::c").alias("source"),
        canonical_json_builtin(F.col("props")).alias("content"),
        F.array(F.when(even, "a::b").otherwise("a")).alias("tags"),
        F.lit(1.0).alias("confidence"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    merged = merge.fold(merge.with_identity(writes), hashed=True)
    return flat(merged.select("content_hash", "type", "source", "created_at", F.size("tags").cast("long").alias("types")))


def upsert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the purchases among the events wrote to, after all writes."""
    writes = V.event_writes(table(spark, sf_dir, "events"))
    batch = writes.filter(F.col("type") == "purchase")
    return flat(merge.touched(merge.upsert(writes.filter(F.col("type") != "purchase"), batch, hashed=True), batch))


def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = V.event_writes(table(spark, sf_dir, "events"))
    merged = merge.fold(writes, hashed=True)
    items = shape.upsert_items(merge.touched(merged, writes))
    return flat(items)


def upsert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.upsert_text(V.event_records(spark, sf_dir))


def append_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged events plus every conversation turn appended without conflict handling."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("type"),
        canonical_json(F.to_json(F.struct("role", "text"))).alias("content"),
        F.lit("chat").alias("source"),
        F.array(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("tags"),
        F.lit(1.0).alias("confidence"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.col("turn").alias("seq"),
    )
    rows = merge.append(V.event_records(spark, sf_dir), merge.with_identity(turns))
    return flat(rows.select("content_hash", "id", "type", "tags", "confidence"))


def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes held more than once before the merge; none are left after it."""
    writes = V.event_writes(table(spark, sf_dir, "events"))
    before = merge.duplicate_hashes(writes).select("content_hash", F.col("count").alias("n"))
    after = merge.duplicate_hashes(merge.fold(writes, hashed=True)).select("content_hash", F.col("count").alias("n"))
    return flat(before.unionByName(after))


# -- filters, browsing -------------------------------------------------------------


def filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(matching(V.event_records(spark, sf_dir), type="click").select("id", "type", "tags"))


def filter_tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching(V.event_records(spark, sf_dir), tags=["user:7", "user:11", "user:none"])
    return flat(rows.select("id", "type", "tags"))


def filter_tags_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tags over a table, half of it pending, of which only buckets with these tags are read."""
    memories = _event_table(spark, sf_dir, Workspace(spark))
    return flat(memories.read_tagged(["user:7", "user:11", "user:none"]).select("id", "type", "tags"))


def filter_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching(V.event_records(spark, sf_dir), type="view", tags=["user:7", "user:11"])
    return flat(rows.select("id", "type", "tags"))


def get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all events (many ask for the same record), ids nobody has, and texts that are no ids."""
    writes = V.event_writes(table(spark, sf_dir, "events"))
    docs = table(spark, sf_dir, "documents")
    requests = (
        writes.select(
            F.concat(F.lit("e"), F.col("first_seq").cast("string")).alias("request_id"),
            F.concat(F.lit(" "), F.upper("id")).alias("id"),
        )
        .unionByName(docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("request_id"), V.uuid_of_text(F.col("text")).alias("id")))
        .unionByName(docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("request_id"), F.col("source").alias("id")))
    )
    # tags become text once for each record, not once for each request
    workspace = Workspace(spark)
    records = workspace.stage(V.event_records(spark, sf_dir), "records")
    return browse.get_by_ids(flat(records), requests, workspace=workspace)


def list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(browse.listed(V.event_records(spark, sf_dir)))


def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = browse.listed(V.event_records(spark, sf_dir), type="view", tags=["user:7", "user:11"])
    return flat(shape.list_items(rows))


def _numbered(rows: DataFrame) -> DataFrame:
    """The place of each row as it comes; a limited list is one partition."""
    return rows.withColumn("rank", F.monotonically_increasing_id() + 1)


def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(flat(browse.recent(V.event_records(spark, sf_dir), 25)))


def recent_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(flat(browse.recent_by_tags(V.event_records(spark, sf_dir), " user:7,,user:11 , USER:1")))


def recent_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(flat(browse.recent_by_type(V.event_records(spark, sf_dir), "error", 1000)))


def _event_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per event: its type, its user, the newest records, or an unknown one, by the kind of event."""
    kind = F.col("event_type")
    limit = F.concat(F.lit("?limit="), (F.floor("value") % 7).cast("string"))
    user = F.concat(F.lit("user%3A"), F.col("user_id").cast("string"))
    address = (
        F.when(kind == "click", F.concat(F.lit("mem://by-type/"), kind, limit))
        .when(kind == "error", F.concat(F.lit("mem://by-tags/"), user, F.lit(",%20user:7"), limit))
        .when(kind == "view", F.concat(F.lit("mem://recent"), limit))
        .otherwise(F.concat(F.lit("mem://unknown/"), kind))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), address.alias("uri"))


def browse_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = browse.browse_many(V.event_records(spark, sf_dir), _event_addresses(spark, sf_dir))
    return found.select("request_id", "rank", "id", "created_at")


def browse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of the addresses that ``browse_many`` leaves out."""
    return browse.refused(_event_addresses(spark, sf_dir))


def parse_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses turned into view addresses: host as type, path as tags."""
    url = F.col("url")
    address = F.when(
        F.contains(url, F.lit("?")), F.concat(F.lit("mem://by-type/"), F.url_encode(url), F.lit("?limit=250&limit=3"))
    ).otherwise(F.concat(F.lit("mem://by-tags/a+b,"), F.url_encode(url)))
    pages = table(spark, sf_dir, "pages").select("page_id", address.alias("uri"))
    return browse.parse_addresses(pages).select("page_id", "view", "argument", F.col("limit").alias("limit_rows"), "error")


def items_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item address of every event's record, and addresses nobody has."""
    writes = V.event_writes(table(spark, sf_dir, "events"))
    docs = table(spark, sf_dir, "documents")
    addresses = writes.select(
        F.concat(F.lit("e"), F.col("first_seq").cast("string")).alias("request_id"), F.col("id")
    ).unionByName(
        docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("request_id"), V.uuid_of_text(F.col("text")).alias("id"))
    )
    addresses = addresses.select("request_id", F.concat(F.lit("mem://item/"), "id").alias("uri"))
    # tags become text once for each record, not once for each request
    workspace = Workspace(spark)
    records = workspace.stage(V.event_records(spark, sf_dir), "records")
    return browse.items_by_address(flat(records), addresses, workspace=workspace)


# -- search ---------------------------------------------------------------------------


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(V.vectors(spark, sf_dir), V.centroid(spark, sf_dir), limit=10)


def search_topk_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(V.vectors(spark, sf_dir), V.centroid(spark, sf_dir), limit=10, scoring="arrow")


def search_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(
        V.typed_vectors(spark, sf_dir), V.centroid(spark, sf_dir), type="en", tags=["src1", "src2", "src3"], limit=20
    )
    return flat(hits)


def search_edge_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are missing, too short, or hold NaN or infinity are not found, by any way of searching."""
    kind = F.col("id") % 7
    damaged = (
        F.when(kind == 0, F.lit(None).cast("array<float>"))
        .when(kind == 1, F.slice("embedding", 1, 5))
        .when(kind == 2, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x)))
        .when(kind == 3, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("inf")).cast("float")).otherwise(x)))
        .otherwise(F.col("embedding"))
    )
    memories = V.vectors(spark, sf_dir).withColumn("embedding", damaged).select("id", "embedding")
    vector = V.centroid(spark, sf_dir)
    query = spark.range(1).select(F.lit(1).alias("query_id"), F.array(*[F.lit(x) for x in vector]).alias("embedding"), F.lit(50).alias("limit"))
    ways = {
        "builtin": search(memories, vector, limit=50, scoring="builtin"),
        "arrow": search(memories, vector, limit=50, scoring="arrow"),
        "many": search_many(memories, query, OPTIONS),
    }
    parts = [hits.select(F.lit(way).alias("way"), "id", "similarity") for way, hits in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _self_queries(memories: DataFrame) -> DataFrame:
    return memories.select(F.col("id").alias("query_id"), "embedding", (F.col("label") + 1).alias("limit"))


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector searches all vectors, each with its own limit."""
    memories = V.vectors(spark, sf_dir)
    return search_many(memories, _self_queries(memories), OPTIONS)


def search_batch_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector searches within its own type; half of the labels also within their source tag."""
    memories = V.typed_vectors(spark, sf_dir)
    return search_many(memories, _filtered_queries(memories), OPTIONS).drop("tags")


def _filtered_queries(memories: DataFrame) -> DataFrame:
    return memories.select(
        F.col("id").alias("query_id"),
        "embedding",
        "type",
        F.when(F.col("label") < 5, F.array("source")).alias("tags"),
        (F.col("label") + 1).alias("limit"),
    )


def search_batch_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``search_batch`` with a query matrix small enough to need several passes."""
    memories = V.vectors(spark, sf_dir)
    return search_many(memories, _self_queries(memories), OPTIONS, block_bytes=256_000)


def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_batch`` over vectors grouped around centres, most of which a query may skip."""
    workspace = Workspace(spark)
    memories = V.vectors(spark, sf_dir)
    groups = grouped.VectorGroups.build(memories, DIM, workspace)
    return grouped.search_grouped(groups, _self_queries(memories), OPTIONS, workspace)


def search_grouped_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_batch_filtered`` over small groups."""
    workspace = Workspace(spark)
    memories = V.typed_vectors(spark, sf_dir)
    groups = grouped.VectorGroups.build(memories, DIM, workspace, group=100)
    return grouped.search_grouped(groups, _filtered_queries(memories), OPTIONS, workspace).drop("tags")


def search_by_label_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of every label searches all vectors."""
    memories = V.vectors(spark, sf_dir)
    means = mean_pool(memories, ["label"], "embedding")
    queries = means.select(
        F.col("label").alias("query_id"), l2_normalize(F.col("embedding")).alias("embedding"), F.lit(15).alias("limit")
    )
    return search_many(memories, queries, OPTIONS)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search digests; a tag that no record of the type has gives the text for nothing found."""
    memories = V.typed_vectors(spark, sf_dir)
    queries = _filtered_queries(memories).withColumn(
        "tags", F.when(F.col("limit") == 10, F.array(F.lit("nobody"))).otherwise(F.col("tags"))
    )
    return shape.search_digests(search_many(memories, queries, OPTIONS), queries)


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = V.typed_vectors(spark, sf_dir).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    hits = search(memories, V.centroid(spark, sf_dir), type="en", limit=50)
    return flat(shape.search_items(hits))


# -- result shapes -----------------------------------------------------------------------


def list_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.list_digest(V.event_records(spark, sf_dir))


def _user_lists(spark: SparkSession, sf_dir: str):
    """A list request for every user: for the user's and the next user's tag, a tag and a type, a type, everything, or
    a faulty one."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    kind, user = F.col("user_id") % 20, F.col("user_id").cast("string")
    own, next_ = F.concat(F.lit("user:"), user), F.concat(F.lit("user:"), (F.col("user_id") + 1).cast("string"))
    raw = (
        F.when(kind < 8, F.to_json(F.struct(F.array(own, next_, own).alias("tags"))))
        .when(kind < 16, F.to_json(F.struct(F.lit(" click").alias("type"), F.array(own).alias("tags"))))
        .when(kind == 16, F.lit('{"type":"view","tags":[]}'))
        .when(kind == 17, F.lit("{}"))
        .when(kind == 18, F.lit('{"tags":["nobody"]}'))
        .otherwise(F.lit('{"tags":"x"}'))
    )
    lines = users.select(F.col("user_id").alias("query_id"), raw.alias("raw"))
    return run_lists(lines, V.event_records(spark, sf_dir), digest_lines=50)


def list_items_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, _ = _user_lists(spark, sf_dir)
    return items.select("query_id", "rank", "id", "type", "created_at")


def list_digests_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per request and chunk, faulty requests with their error."""
    _, digests, rejected = _user_lists(spark, sf_dir)
    errors = rejected.select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("chunks"), F.col("error").alias("text"))
    return digests.unionByName(errors)


def resource_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.with_links(V.event_records(spark, sf_dir).select("id"))


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(shape.full_records(V.event_records(spark, sf_dir)))


def record_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.record_cards(V.event_records(spark, sf_dir))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(V.event_records(spark, sf_dir).select("id", "type", "content", "tags"))


# -- whole jobs ------------------------------------------------------------------------------


def _document_table(spark: SparkSession, sf_dir: str, workspace: Workspace) -> MemoryTable:
    embedder = HashingEmbedder(DIM)
    memories = MemoryTable.create(spark, workspace.path("table"), DIM, embedder.model)
    create(V.document_lines(spark, sf_dir), memories, embedder, OPTIONS, workspace=workspace)
    return memories


CREATED = ["content_hash", "id", "type", "source", "tags", "confidence", "embedding"]


def create_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the create job: validate, merge, embed, write, read back."""
    rows = _document_table(spark, sf_dir, Workspace(spark)).read(columns=CREATED)
    width = F.size("embedding").alias("width")
    return flat(rows.select("content_hash", "id", "type", "source", "tags", "confidence", width))


def create_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents, then all: the second batch embeds only what is new, and nothing loses its vector."""
    workspace = Workspace(spark)
    lines = V.document_lines(spark, sf_dir)
    embedder = HashingEmbedder(DIM)
    memories = MemoryTable.create(spark, workspace.path("table"), DIM, embedder.model)
    create(lines.filter("seq % 3 != 0"), memories, embedder, OPTIONS, workspace=workspace)
    memories.compact()
    create(lines, memories, embedder, OPTIONS, workspace=workspace)
    width = F.size("embedding").alias("width")
    return flat(memories.read(columns=CREATED).select("content_hash", "id", "type", "source", "tags", "confidence", width))


def create_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents while the model fails for half of them, then a batch without lines when it works again: what waited is
    created as if nothing had happened. ``waiting`` counts what is left."""
    workspace = Workspace(spark)
    memories = MemoryTable.create(spark, workspace.path("table"), DIM, HashingEmbedder(DIM).model)
    lines, retry = V.document_lines(spark, sf_dir), Retry(attempts=3, delay=timedelta(minutes=10))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    options = Options(dim=DIM, embed_retries=1)
    create(lines, memories, Down(DIM), options, ts=start, retry=retry, workspace=workspace, pause=0.0, batch=16)
    for minutes in (5, 15):  # too early, then due
        create(lines.limit(0), memories, HashingEmbedder(DIM), options, ts=start + timedelta(minutes=minutes), retry=retry, workspace=workspace)
    rows = memories.read(columns=[*CREATED, "created_at"])
    at = (F.col("created_at") == F.lit(start)).alias("first_time")
    waiting = F.lit(len(memories.backlog())).alias("waiting")
    return flat(rows.select("content_hash", "id", "type", "source", "tags", "confidence", F.size("embedding").alias("width"), at, waiting))


def reuse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct document text: is there a stored vector, when two thirds of the documents were created?"""
    workspace = Workspace(spark)
    embedder = HashingEmbedder(DIM)
    memories = MemoryTable.create(spark, workspace.path("table"), DIM, embedder.model)
    lines = V.document_lines(spark, sf_dir)
    create(lines.filter("seq % 3 = 1"), memories, embedder, OPTIONS, workspace=workspace)
    memories.compact()
    create(lines.filter("seq % 3 = 2"), memories, embedder, OPTIONS, workspace=workspace)
    keys = V.document_texts(spark, sf_dir).select(embedding_key(F.col("content"), embedder.model).alias("embed_key")).distinct()
    stored = memories.stored_vectors(keys, workspace).select("embed_key", F.size("embedding").alias("width"))
    return keys.join(stored, "embed_key", "left")


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a search request over the table of documents."""
    workspace = Workspace(spark)
    memories = _document_table(spark, sf_dir, workspace).read()
    lines = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("query_id"),
        F.to_json(F.struct(F.col("text").alias("query"), F.lit(5).alias("limit"))).alias("raw"),
    )
    hits, _, _ = run_searches(lines, memories, HashingEmbedder(DIM), OPTIONS, workspace=workspace)
    return flat(hits.drop("created_at", "updated_at"))


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of four files, merged in streaming state."""
    workspace = Workspace(spark)
    events = table(spark, sf_dir, "events")
    source, changes = workspace.path("events"), workspace.path("changes")
    events.repartition(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    write_changes(
        stream_fold(V.event_writes(stream)), changes, workspace.path("checkpoint"), available_now=True
    ).awaitTermination()
    return flat(latest(spark, changes).select(*RECORD))


def stream_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of four files, merged in keyed state with a map of tags; the changes are folded."""
    workspace = Workspace(spark)
    events = table(spark, sf_dir, "events")
    source, changes = workspace.path("events"), workspace.path("changes")
    events.repartition(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    write_changes(
        keyed_fold(V.event_writes(stream)), changes, workspace.path("checkpoint"), available_now=True
    ).awaitTermination()
    fold_changes(spark, changes, keep=1)
    return flat(last_changes(spark, changes).select(*RECORD))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of request lines through the create job into the table."""
    workspace = Workspace(spark)
    source = workspace.path("lines")
    V.event_lines(table(spark, sf_dir, "events")).repartition(4, "seq").select("raw").write.text(source)
    embedder = HashingEmbedder(DIM)
    memories = MemoryTable.create(spark, workspace.path("table"), DIM, embedder.model)
    ingest_stream(
        read_lines_stream(spark, source, files_per_batch=2),
        memories,
        embedder,
        checkpoint=workspace.path("checkpoint"),
        rejects_path=workspace.path("rejects"),
        options=OPTIONS,
        available_now=True,
    ).awaitTermination()
    columns = ["content_hash", "id", "type", "content", "source", "tags", "confidence"]
    return flat(memories.read(columns=columns))


QUERIES = {
    "validate_creates": validate_creates,
    "validate_edge_creates": validate_edge_creates,
    "rejects_by_error": rejects_by_error,
    "validate_searches": validate_searches,
    "validate_lists": validate_lists,
    "content_hash": content_hash,
    "canonical_pages": canonical_pages,
    "canonical_numbers": canonical_numbers,
    "lexemes": lexemes,
    "lexemes_stored": lexemes_stored,
    "embed_key": embed_key,
    "embed_distinct": embed_distinct,
    "embed_once": embed_once_,
    "embed_retry": embed_retry,
    "reject_vectors": reject_vectors,
    "embed_cls_raw": embed_cls_raw,
    "mean_pool_normalize": mean_pool_normalize,
    "dimension_check": dimension_check,
    "upsert_fold": upsert_fold,
    "upsert_incremental": upsert_incremental,
    "compact_buckets": compact_buckets,
    "known_hashes": known_hashes,
    "first_writer": first_writer,
    "upsert_returning": upsert_returning,
    "upsert_items": upsert_items,
    "upsert_text": upsert_text,
    "append_plain": append_plain,
    "duplicate_hashes": duplicate_hashes,
    "filter_type": filter_type,
    "filter_tags_any": filter_tags_any,
    "filter_tags_lookup": filter_tags_lookup,
    "filter_both": filter_both,
    "get_by_ids": get_by_ids,
    "list_newest": list_newest,
    "list_filtered": list_filtered,
    "recent_n": recent_n,
    "recent_by_tags": recent_by_tags,
    "recent_by_type": recent_by_type,
    "browse_many": browse_many,
    "browse_lists": browse_lists,
    "browse_rejects": browse_rejects,
    "items_by_address": items_by_address,
    "parse_addresses": parse_addresses,
    "search_topk": search_topk,
    "search_topk_arrow": search_topk_arrow,
    "search_edge_vectors": search_edge_vectors,
    "search_filtered_topk": search_filtered_topk,
    "search_batch": search_batch,
    "search_batch_filtered": search_batch_filtered,
    "search_batch_passes": search_batch_passes,
    "search_grouped": search_grouped,
    "search_grouped_filtered": search_grouped_filtered,
    "search_by_label_mean": search_by_label_mean,
    "search_items": search_items,
    "digest": digest,
    "list_digest": list_digest,
    "list_items_many": list_items_many,
    "list_digests_many": list_digests_many,
    "resource_links": resource_links,
    "full_records": full_records,
    "record_cards": record_cards,
    "json_lines": json_lines,
    "create_documents": create_documents,
    "create_incremental": create_incremental,
    "create_retried": create_retried,
    "reuse_vectors": reuse_vectors,
    "search_documents": search_documents,
    "stream_upsert": stream_upsert,
    "stream_keyed": stream_keyed,
    "stream_ingest": stream_ingest,
}
