"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, count_alnum_words, own_names

WINDOW = 13
SHINGLE = 5
#: Up to so many distinct keys of shingles or prefixes are broadcast (some 40 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: Up to so many texts' hits are broadcast where they meet the documents again; more are joined by shuffle.
BROADCAST_HITS = 100_000


def gram_key(hashes: Column, at: Column, k: int) -> Column:
    """A key of k consecutive word hashes."""
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(k)])


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, hashes, len, k): every window of `window` consecutive words of each item, shorter items as one window,
    the hashes of its words, and the shingle length that serves it. Items without words have none."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    out = words.select("item_id", "words", n.alias("len"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    out = out.select("item_id", F.slice("words", F.col("at") + 1, F.col("len")).alias("win"), "len", F.least(F.col("len"), F.lit(SHINGLE)).alias("k")).distinct()
    return out.withColumn("hashes", word_hashes(F.col("win")))


def window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every window: (item_id, win, hashes, len, k, offset, key)."""
    at = F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("offset")
    key = F.coalesce(*[F.when(F.col("k") == k, gram_key(F.col("hashes"), F.col("offset"), k)) for k in sizes])
    return windows.select("*", at).withColumn("key", key)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, Scratch]:
    """(doc_id, h, start, len, item_id, win): every place of a text where the words' hashes are those of an item's window. h is
    the text's hash; the pair names a row, and rows alike in both have the same hits.

    Texts are split into words once; their hashes are written down. A first pass over them counts, for all shingle
    lengths together, how often each shingle of the windows stands in all documents: keys alone, combined before the
    shuffle. Containment of a whole window needs each of its shingles, so one is prefix enough: the rarest. Only
    prefixes are joined with the documents in the second pass; windows with one that no document has are done by then.
    A place where the window would not fit the text (length and position) falls out before hashes are compared.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    windows = scratch.save(item_windows(items, window))
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())  # 1 to SHINGLE
    if not sizes:
        return docs.select("doc_id", F.xxhash64("text").alias("h"), F.lit(0).alias("start")).where("false").join(windows.select("len", "item_id", "win").limit(0)), scratch
    shingles = scratch.save(window_shingles(windows, sizes))
    slim = scratch.save(docs.select("doc_id", F.xxhash64("text").alias("h"), word_hashes(alnum_words(F.col("text"))).alias("hashes")).where(F.size("hashes") > 0))
    each = slim.select("doc_id", "h", "hashes", F.posexplode("hashes").alias("pos", "hash"))
    at = [F.when(F.col("pos") + k <= F.size("hashes"), gram_key(F.col("hashes"), F.col("pos"), k)) for k in sizes]
    each = each.select("doc_id", "h", "hashes", "pos", at[0].alias("key") if len(at) == 1 else F.explode(F.array(*at)).alias("key"))

    counts = scratch.save(each.select("key").join(_small(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("freq")))
    rare = shingles.join(counts, "key", "left").groupBy("item_id", "win", "hashes", "len").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key", "offset")).alias("p"))
    prefix = scratch.save(rare.where("p.freq > 0").select("item_id", "win", F.col("hashes").alias("wanted"), "len", F.col("p.key").alias("key"), F.col("p.offset").alias("offset")))
    hits = each.join(_small(prefix), "key").withColumn("start", F.col("pos") - F.col("offset"))
    hits = hits.where("start >= 0 AND start + len <= size(hashes)").where(F.slice("hashes", F.col("start") + 1, F.col("len")) == F.col("wanted"))
    return hits.select("doc_id", "h", "start", "len", "item_id", "win"), scratch


def covered(spans: Column) -> Column:
    """Words inside any of an array of (start, end)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(a: Column, x: Column) -> Column:
        return F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto"))

    return F.aggregate(F.sort_array(spans), start, add, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """docs with n_words, n_hit (words inside any window), n_full (those inside windows of full length), n_items, items (sorted
    item ids as strings), contaminated.

    contaminated: n_hit > 0 and one_in * n_hit >= n_words. Windows found by their words' hashes are compared with the text
    word for word. Null or empty text has no words and no hits. Items that have
    no words never hit; an item with a null id hits words but isn't counted. Repeated rows are judged alike. Columns of
    the new names are replaced, those that begin with an underscore are left out, other columns stay. With no items nothing is contaminated.
    """
    docs = own_names(docs).drop("n_words", "n_hit", "n_full", "n_items", "items", "contaminated")
    hits, scratch = find_hits(docs, items, window)
    hit = F.struct("start", (F.col("start") + F.col("len")).alias("end"), "win", F.col("item_id").cast("string").alias("item"))
    per = scratch.save(hits.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(hit).alias("_hits")))
    few = per.count() <= BROADCAST_HITS  # the texts that share a window with the benchmark
    small = F.broadcast if few else lambda df: df
    same = lambda rows, per: rows.doc_id.eqNullSafe(per._id) & (rows._text == per._h)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    found = rows.join(small(per.select("_id", "_h")), same(rows, per)).select("_id", "_h", alnum_words(F.col("text")).alias("_words"))
    found = found.dropDuplicates(["_id", "_h"]).withColumnsRenamed({"_id": "_i", "_h": "_t"})
    found = found.join(per, found._i.eqNullSafe(per._id) & (found._t == per._h))
    found = found.withColumn("_hits", F.filter("_hits", lambda x: F.slice("_words", x["start"] + 1, x["end"] - x["start"]) == x["win"]))
    spans = lambda xs: covered(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    ids = F.filter(F.transform("_hits", lambda x: x["item"]), lambda x: x.isNotNull())
    full = F.filter("_hits", lambda x: x["end"] - x["start"] == window)
    found = scratch.save(found.select("_id", "_h", spans(F.col("_hits")).alias("n_hit"), spans(full).alias("n_full"), F.sort_array(F.array_distinct(ids)).alias("items")))

    rows = docs.withColumns({"n_words": count_alnum_words(F.col("text")), "_text": F.xxhash64("text")})
    out = rows.join(small(found), same(rows, found), "left").drop("_id", "_h", "_text")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_full": F.coalesce("n_full", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.expr(f"n_hit > 0 AND {one_in} * n_hit >= n_words")})
