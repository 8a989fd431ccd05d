"""Benchmark decontamination by winnowing, in Spark's own functions only.

Of each window of SPAN - K + 1 consecutive K-grams the one of least hash is kept, the leftmost on
ties. Which one that is depends on the window's words alone, so every span of SPAN words that a
document and an item share gives both the same fingerprint at the same place of the span: joining
fingerprints finds all of them. Hits then are extended to the whole span and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, stored, unused

SPAN, K = 10, 5
#: The low bits of a fingerprint hold its place in the document.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Benchmarks of at most so many windows and bytes are broadcast; larger ones are shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 50_000, 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z (of other letters, nothing changes)."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAPS), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS_ANY_CASE), ""))


def _grams(w: Column, k: int) -> Column:
    """All k-grams of a word array: hash in the high bits, place in the low ones."""
    mark = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long"))
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), mark)).otherwise(F.array().cast("array<long>"))


def fingerprints(w: Column) -> Column:
    """The winnowed K-grams of a word array; texts under SPAN words have none."""
    kept = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - (SPAN - K + 1)), lambda i: F.least(*[F.get(g, i + j) for j in range(SPAN - K + 1)])))
    return F.when(F.size(w) >= SPAN, let(_grams(w, K), kept)).otherwise(F.array().cast("array<long>"))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``(h, off, len, win, item_id)``: each window of each item with its fingerprint and that one's place in it."""
    one = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0))))
    win = one.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s") + 1, SPAN).alias("win")).distinct()
    mark = F.when(F.size("win") >= SPAN, F.array_min(_grams(F.col("win"), K)))
    for k in range(1, SPAN):
        mark = mark.when(F.size("win") == k, F.element_at(_grams(F.col("win"), k), 1))
    win = win.withColumn("mark", mark.otherwise(F.lit(0)))
    return win.select(
        F.col("mark").bitwiseAND(F.lit(~PLACES)).alias("h"), F.col("mark").bitwiseAND(F.lit(PLACES)).cast("int").alias("off"), F.size("win").alias("len"), F.array_join("win", " ").alias("win"), "item_id"
    )


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_id, text_key, start, len, win)``: the places where a window of an item occurs in a document."""
    distinct = windows.select("h", "off", "len", "win").distinct()
    lengths = [r.len for r in windows.where(F.col("len") < SPAN).select("len").distinct().collect()]  # SPAN - 1 at most
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("win")), F.lit(0))).first()
    few = n <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES
    marks = lambda w: F.concat(fingerprints(w), *[_grams(w, k) for k in sorted(lengths)])
    both = let(words_of(F.col("text")), lambda w: F.struct(w.alias("w"), marks(w).alias("marks")))
    wide = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), both.alias("d"))
    each = wide.select("doc_id", "text_key", F.col("d.w").alias("w") if few else F.lit(None).alias("w"), F.explode("d.marks").alias("mark"))
    each = each.select("doc_id", "text_key", "w", F.col("mark").bitwiseAND(F.lit(~PLACES)).alias("h"), F.col("mark").bitwiseAND(F.lit(PLACES)).cast("int").alias("at"))
    start = F.col("at") - F.col("off")
    same = (start >= 0) & (F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ") == F.col("win"))
    if few:
        hits = each.join(F.broadcast(distinct), "h").where(same)
    else:
        near = each.drop("w").join(distinct, "h").distinct()
        texts = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), words_of(F.col("text")).alias("w")).dropDuplicates(["doc_id", "text_key"])
        on = near["doc_id"].eqNullSafe(texts["doc_id"]) & (near["text_key"] == texts["text_key"])
        hits = near.join(texts, on).select(near["doc_id"], near["text_key"], "at", "off", "len", "win", "w").where(same)
    return hits.select("doc_id", "text_key", start.alias("start"), "len", "win").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and no hits; items without words match nothing; items under
    SPAN words match as a whole. Documents are told apart by id (nulls equal) and text, so repeated
    rows each have their row; an item_id that repeats counts once, and items
    without an id count for hits alone. Other columns don't matter.
    """
    from pyspark.sql import Window

    docs = docs.select("doc_id", "text")
    windows = stored(benchmark_windows(items))
    hits = stored(find_hits(docs, windows))
    key = ["doc_id", "text_key"]
    spans = hits.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    reached = F.max("end").over(Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("reached", F.lit(0))), F.lit(0))
    n_hit = spans.withColumn("reached", reached).groupBy(*key).agg(F.sum(fresh).cast("long").alias("n_hit"))
    owners = windows.select("win", F.col("item_id").cast("string").alias("item")).distinct()
    found = hits.select(*key, "win").distinct().join(owners, "win").select(*key, "item").distinct()
    found = found.groupBy(*key).agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    base = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), count_words(F.col("text")).cast("long").alias("n_words"))
    for more in (n_hit, found):
        more = more.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_key", "__key")
        base = base.join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").drop("__id", "__key")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return base.select(
        "doc_id", "text_key", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns, whatever their names.

    Texts without words (null, empty) stay, however long a text is it is looked at whole, rows that repeat
    stay or go together, and empty tables of documents or items are borne.
    """
    own_id, own_key = unused(docs, "id", "key")
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own_id)) & (key == F.col(own_key)), "left_anti")


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w, row_number() over () as r from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bs as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0),
win as (select distinct item_id, w[s:s + 9] as win from bs),
lens as (select distinct len(win) as n from win),
ds as (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n),
hits as (select r, s, n, item_id from (select r, s, n, w[s:s + n - 1] as win from ds) join win using (win)),
cov as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hits) group by 1),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hits where item_id is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (r) left join its using (r)
"""
