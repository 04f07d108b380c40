"""Benchmark decontamination by a distributed positional inverted index.

Everything is DataFrame and SQL functions.

1. Test items are cut into windows of ``width`` words in a row (a shorter item is one window). A
   window may be led by its ``LEADS`` terms that are rarest among the test items.
2. One scan of the corpus stores the postings (term, rid, pos) of all leading terms, as segments: each
   file is sorted by term, so a list is read without the others, and nothing is shuffled.
3. Corpus counts of the terms, from the whole index, order the leading terms of each window. The
   postings of its rarest term, less the term's offset, are the candidate starts; they are intersected
   with the offset-adjusted lists of the next rarest terms.
4. What is left is compared word by word with the texts of the documents concerned, which gives
   the exact phrase matches. ``proximity`` finds terms near each other instead.

A row of the corpus is known by the hash of its id and text, so that repeated rows share their result.

Edge cases: a null or wordless text has no words and no hits; an item without words has no window;
items that share a window all count; equal rows give equal results, one each; an empty corpus or
an empty benchmark gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistline.llm import common
from gistline.session import fits_broadcast, lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Terms that may lead the search for a window, and how many lists are intersected.
LEADS, LISTS = 4, 3


def words_of(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(item_id, wid, terms): windows of the items; equal windows have one wid."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = items.withColumn("words", words_of("text")).where(F.size("words") > 0).select(
        "item_id", "words", F.explode(starts).alias("at")
    )
    return cut.withColumn("terms", F.slice("words", F.col("at"), width)).select("item_id", F.xxhash64("terms").alias("wid"), "terms").distinct()


def leads_of(windows: DataFrame) -> DataFrame:
    """(wid, terms, term, at): the terms that may lead each window, by their number of windows among the items."""
    terms = windows.select("wid", "terms").dropDuplicates(["wid"])
    each = terms.select("wid", "terms", F.posexplode("terms").alias("at", "term"))
    often = common.stored(each.groupBy("term").agg(F.count(F.lit(1)).alias("often")))
    # a term of many windows must not meet its count in one task
    first = lookup(each.groupBy("wid", "term").agg(F.min("at").alias("at"), F.first("terms").alias("terms")), often, ["term"], "inner")
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("often", "term"))
    return first.withColumn("rank", rank).where(F.col("rank") <= LEADS).select("wid", "terms", "term", "at")


def with_rid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.xxhash64("doc_id", "text"))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, rid, pos), stored as segments sorted by term; of the given terms only, if any are given."""
    postings = with_rid(docs).withColumn("words", words_of("text")).select("rid", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        postings = lookup(postings, terms, ["term"], "inner")
    return common.stored(postings.select("term", "rid", "pos").sortWithinPartitions("term", "rid", "pos"))


def _of_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of some terms: only these leave the scan if the terms are few."""
    terms = common.stored(terms.select("term").distinct())
    return index.join(F.broadcast(terms) if fits_broadcast(terms) else terms, "term")


def candidates(index: DataFrame, leads: DataFrame) -> DataFrame:
    """(wid, rid, start): starts at which the rarest terms of a window stand at their places."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = lookup(leads, common.stored(counts), ["term"]).groupBy("wid").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias("ranked")
    )
    # a term that the corpus lacks rules its window out
    ranked = common.stored(ranked.where(F.col("ranked")[0]["n"] > 0))
    found = before = None
    for k in range(LISTS):
        lead = F.get("ranked", F.least(F.lit(k), F.size("ranked") - 1))
        lists = ranked.select("wid", lead["term"].alias("term"), lead["at"].alias("at"))
        if found is None:
            found = lookup(_of_terms(index, lists), lists, ["term"], "inner").select("wid", "rid", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0")
        else:
            wanted = lookup(found, lists, ["wid"], "inner").select("wid", "rid", "start", "term", (F.col("start") + F.col("at")).alias("pos"))
            found = wanted.join(_of_terms(index, lists), ["term", "rid", "pos"]).select("wid", "rid", "start")
        old, found = before, common.stored(found.distinct())
        common.discard(old)
        before = found
    common.discard(ranked)
    return found


def matches(docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact phrase matches per row of ``docs``: doc_id, n_words, hits (places), n_hit, item_ids (sorted as text)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    windows = common.stored(windows_of(items, width))
    leads = common.stored(leads_of(windows))
    index = build_index(docs, leads.select("term").distinct())
    starts = candidates(index, leads)
    found = lookup(starts, windows.select("wid", "terms").dropDuplicates(["wid"]), ["wid"], "inner")
    per_row = common.stored(found.groupBy("rid").agg(F.collect_list(F.struct("wid", "start", "terms")).alias("found")))
    common.discard(index, starts, leads)
    rows = with_rid(docs).join(per_row, "rid", "left").withColumn("words", words_of("text"))
    exact = F.filter("found", lambda c: F.slice(F.col("words"), c["start"] + 1, F.size(c["terms"])) == c["terms"])
    places = F.array_distinct(F.flatten(F.transform("exact", lambda c: F.sequence(c["start"], c["start"] + F.size(c["terms"]) - 1))))
    rows = common.stored(
        rows.withColumn("exact", F.when(F.col("found").isNotNull(), exact).otherwise(F.filter("found", lambda c: F.lit(False))))
        .select("rid", "doc_id", F.size("words").cast("bigint").alias("n_words"),
                F.array_distinct(F.transform(F.coalesce("exact", F.array()), lambda c: c["wid"])).alias("wids"),
                F.coalesce(places, F.array().cast("array<int>")).alias("hits"))
    )
    common.discard(per_row)
    of_window = windows.select("wid", "item_id").distinct()
    hit_items = lookup(rows.select("rid", F.explode("wids").alias("wid")).distinct(), of_window, ["wid"], "inner")
    listed = hit_items.groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return rows.join(listed, "rid", "left").select(
        "doc_id", "rid", "n_words", "hits", F.size("hits").cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def proximity(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(qid, rid, pos): places of a query's rarest term with all its other terms at most ``slop`` words away.

    ``queries`` holds (qid, terms). Postings meet in stretches of ``slop`` places and the two beside them,
    so a frequent term of a long text is not paired with all of its places.
    """
    each = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("qid").orderBy("n", "term"))
    )
    ranked = common.stored(ranked)
    size = ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    near = F.floor(F.col("pos") / (slop + 1))
    led = index.join(ranked.where("rank = 1").select("qid", "term"), "term").select("qid", "rid", F.col("pos").alias("lead"), near.alias("stretch"))
    others = index.join(ranked.where("rank > 1").select("qid", "term"), "term").select("qid", "rid", "term", "pos", near.alias("stretch"))
    wide = led.withColumn("stretch", F.explode(F.array(*(F.col("stretch") + d for d in (-1, 0, 1)))))
    met = wide.join(others, ["qid", "rid", "stretch"]).where(F.abs(F.col("pos") - F.col("lead")) <= slop)
    full = met.groupBy("qid", "rid", "lead").agg(F.count_distinct("term").alias("met"))
    alone = led.select("qid", "rid", "lead").distinct().withColumn("met", F.lit(0).cast("bigint"))
    return (
        full.unionByName(alone).groupBy("qid", "rid", "lead").agg(F.max("met").alias("met")).join(size, "qid")
        .where(F.col("met") == F.col("size") - 1).select("qid", "rid", F.col("lead").alias("pos"))
    )


def keep(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of documents without a hit, with their own columns."""
    own = common.fresh(docs, "hit_rid")[0]
    hit = matches(docs, items, doc_id=doc_id, text=text, **options).where("n_hit > 0").select(F.col("rid").alias(own)).distinct()
    return docs.join(hit, F.xxhash64(F.col(doc_id), F.col(text)) == F.col(own), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = matches(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
