"""Document fingerprints from closed syncmers of words.

A run of K words is an anchor when the smallest of its inner runs of S words (by hash) stands at
its start or at its end. Whether it is one depends on its own words alone, so what is common to two
texts has the same anchors in both, wherever it stands; an edit changes only the anchors it touches.
A fingerprint lists the anchors of the whole text in order, eight hex digits each. Likeness matches anchors by
place: the k-th of a kind in one text with the k-th in the other. Matches that follow each other in both texts count as one
run; where a run ends because what follows stands elsewhere, one match is not counted. So moved blocks cost one match each, a shuffled text is like
nothing, and a repeated passage counts as often as both texts have it.

Everything is built-in expressions. The neighbour of a document (the next one in falling
order of id) comes from a window over ranges of ids; the first document of a range finds its
neighbour in a copy of the last one of the range before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.bind import let

K, S = 6, 2  # words; the expressions below spell out K - S + 1 = 5 inner runs
CELLS = 128  # ranges by quantiles of the id
ROWS = 2000  # documents in a part of a range, about


def anchors(text: Column) -> Column:
    """Hashes (31 bits, the top bit set) of the anchors of a text, in order.

    Words are the units; in a text with fewer than K words its characters are (white space as one
    space). With fewer than K characters the one anchor is the hash of all; without words there is
    none. Null reads as empty.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    letters = F.filter(F.split(F.array_join(words, " "), ""), lambda c: c != "")
    units = F.when(F.size(words) < K, letters).otherwise(words)

    def digest(hash64: Column) -> Column:
        return F.shiftright(hash64, 33).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(0x80000000))

    def of_runs(g: Column) -> Column:
        def anchor(first: Column, i: Column) -> Column:
            last = F.get(g, i + 4)
            middle = F.least(F.get(g, i + 1), F.get(g, i + 2), F.get(g, i + 3))
            return F.when(middle >= F.least(first, last), digest(F.xxhash64(first, F.get(g, i + 2), last)))

        return F.filter(F.transform(F.slice(g, 1, F.size(g) - 4), anchor), F.isnotnull)

    def of_units(h: Column) -> Column:
        runs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        whole = F.array(digest(F.xxhash64(F.array_join(F.transform(h, lambda v: v.cast("string")), " "))))
        few = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(whole)
        return F.when(F.size(h) < K, few).otherwise(let(runs, of_runs))

    return let(F.transform(units, lambda w: F.xxhash64(w)), of_units)


def as_text(found: Column) -> Column:
    """Anchors as a string of eight hex digits each."""
    return F.lower(F.array_join(F.transform(found, F.hex), ""))


def numbered(found: Column) -> Column:
    """A key for each anchor, in order: its hash, and how many of the same stand before it. No key comes twice."""
    places = F.array_sort(F.transform(found, lambda a, i: F.struct(a.alias("anchor"), i.alias("place"))))

    def of_sorted(s: Column) -> Column:
        def keys(hashes: Column) -> Column:
            def key(entry: Column, i: Column) -> Column:
                again = F.get(hashes, i - 1) == entry["anchor"]
                before = F.when(again, i + 1 - F.array_position(hashes, entry["anchor"])).otherwise(F.lit(0).cast("bigint"))
                return F.struct(entry["place"].alias("place"), (F.shiftleft(entry["anchor"], 31) + before).alias("key"))

            return F.transform(F.array_sort(F.transform(s, key)), lambda e: e["key"])

        return let(F.transform(s, lambda e: e["anchor"]), keys)

    single = F.transform(found, lambda a: F.shiftleft(a, 31))
    return F.when(F.size(F.array_distinct(found)) == F.size(found), single).otherwise(let(places, of_sorted))


def likeness(one: Column, other: Column) -> Column:
    """Matches over keys in either of two texts (``numbered``), less one match for each break in their order;
    1 when neither text has any."""

    def steps(keys: Column) -> Column:
        return F.transform(F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0))), lambda k, i: F.xxhash64(k, F.get(keys, i + 1)))

    def share(here: Column, there: Column) -> Column:
        both = F.size(here)
        kept = F.size(F.array_intersect(steps(here), steps(there)))
        breaks = F.greatest(both - 1 - kept, F.lit(0))
        either = F.size(one) + F.size(other) - both
        return F.when(either == 0, F.lit(1.0)).otherwise((both - breaks) / either)

    return let(F.array_intersect(one, other), lambda here: let(F.array_intersect(other, one), lambda there: share(here, there)))


def matches(one: Column, other: Column) -> Column:
    """The matches of two texts (``numbered``) with their places in both: array of (key, place, other_place)."""
    found = F.transform(one, lambda k, i: F.struct(k.alias("key"), i.alias("place"), (F.array_position(other, k) - 1).alias("other_place")))
    return F.filter(found, lambda m: m["other_place"] >= 0)


def _parts(docs: DataFrame) -> Column:
    """The range of an id as a number that rises with it.

    CELLS quantiles make cells; a cell is cut evenly into parts of about ROWS documents. Rows without id stand first.
    """
    facts = docs.agg(
        F.count("*").alias("n"),
        F.percentile_approx("doc_id", [i / CELLS for i in range(CELLS + 1)], 10_000).alias("q"),
    ).first()
    edges = sorted(set(facts["q"] or [0]))
    pieces = max(1, -(-facts["n"] // (ROWS * max(1, len(edges) - 1))))
    low = F.array(*[F.lit(e).cast("double") for e in edges])
    cell = F.greatest(F.lit(1), F.size(F.filter(low, lambda e: e <= F.col("doc_id"))))
    start, stop = F.element_at(low, cell), F.get(low, cell)
    inside = F.floor((F.col("doc_id") - start) / F.greatest(stop - start, F.lit(1.0)) * pieces)
    inside = F.least(F.greatest(F.coalesce(inside, F.lit(0)), F.lit(0)), F.lit(pieces - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(cell * pieces + inside).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in falling order of id, after the last one that
    of the first. Null texts read as empty; equal ids stand in the order of text, rows without id last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", _parts(docs))
    # the highest row of every part goes to the next higher part as well, that of the highest to the lowest
    top = rows.groupBy("part").agg(F.max(F.struct("doc_id", "text")).alias("top"))
    upward = Window.orderBy("part")
    whole = upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = rows.select("part").distinct().select("part", F.coalesce(F.lead("part").over(upward), F.min("part").over(whole)).alias("to"))
    ghosts = top.join(to, "part").select(F.col("top.doc_id").alias("doc_id"), F.col("top.text").alias("text"), F.col("to").alias("part"))
    every = rows.withColumn("own", F.lit(True)).unionByName(ghosts.withColumn("own", F.lit(False)))
    order = Window.partitionBy("part").orderBy("own", F.col("doc_id").asc_nulls_first(), "text")
    return every.withColumn("next_text", F.lag("text").over(order)).filter("own").select("doc_id", "text", "next_text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, the fingerprint, that of the edited text, and likenesses.

    The edited text has its last third (whole code points) replaced by the start of the next document.
    An empty table gives no rows; a single row is its own next document.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited)

    def facts(a: Column, b: Column, c: Column) -> Column:
        return F.struct(
            as_text(a).alias("fingerprint"),
            as_text(b).alias("edited_fingerprint"),
            let(numbered(a), lambda x: F.struct(let(numbered(b), lambda y: likeness(x, y)).alias("e"), let(numbered(c), lambda y: likeness(x, y)).alias("n"))).alias("near"),
        )

    value = let(
        anchors(F.col("text")),
        lambda a: let(anchors(F.col("edited")), lambda b: let(anchors(F.col("next_text")), lambda c: facts(a, b, c))),
    )
    found = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), value.alias("f"))
    found = found.select("doc_id", "n_chars", "edited_sha256", F.inline(F.array("f")))
    return found.select(*found.columns[:-1], F.col("near.e").alias("near_edited"), F.col("near.n").alias("near_next"))
