"""Substring dedup: paragraph MinHash banding, verified by exact Jaccard, clustered by components; passages inside
paragraphs by content-chosen windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, merged, own_names, small_batches

#: Lines of fewer words count as short: runs of them are paragraphs too.
MIN_WORDS = 25
#: Words of a shingle, and so of the shortest paragraph that counts.
SHINGLE = 5
JACCARD = 0.8
#: A pair of similarity JACCARD meets in one of BANDS bands of ROWS minima: 1 - (1 - 0.8 ** 3) ** 7 = 0.993.
BANDS, ROWS = 7, 3
#: Paragraphs of a bucket that are compared at once; larger buckets are cut into blocks.
BLOCK = 500
#: Rows without a doc_id get numbers from here on; doc_ids are smaller.
NO_ID = 1 << 62
#: Texts are also compared by windows of PASSAGE words, which start at the least hash of any WINNOW consecutive ones. So
#: every shared passage of PASSAGE + WINNOW - 1 words has a window in common, whatever surrounds it; extended() finds its ends.
PASSAGE, WINNOW = 24, 9

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: One more than each byte, A-Z as a-z.
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32
_seeds = np.random.Generator(np.random.PCG64(5))
_MUL = _seeds.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


#: Shingles of a text whose permuted hashes are held for all minima at once.
_AT_ONCE = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 to the 64, as many as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of values[start:end] for each span, by prefix sums; the same for equal spans wherever they stand."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Text:
    """A text's words as byte spans and hashes. A-Z count as a-z."""

    def __init__(self, text: str):
        self.raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        space = np.ones(len(self.raw) + 2, bool)
        space[1:-1] = _SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            self.hashes = _spans(_LOWER[self.raw], self.starts, self.ends, _BYTES)

    def units(self) -> np.ndarray:
        """Lines as word spans, and after them the other spans that count as one: lines up to a blank one, and runs of lines
        of fewer than MIN_WORDS words. None of fewer than SHINGLE words."""
        lo, breaks = [0], [0]
        for at in np.searchsorted(self.starts, np.flatnonzero(self.raw == 10)).tolist():
            if at == lo[-1]:
                breaks[-1] += 1
            else:
                lo.append(at)
                breaks.append(1)
        hi = [*lo[1:], len(self.starts)]
        short = [b - a < MIN_WORDS for a, b in zip(lo, hi)]
        more, part, run = set(), 0, 0
        for i in range(1, len(lo) + 1):
            ends = i == len(lo) or breaks[i] > 1
            if ends or short[i] != short[run]:
                if short[run] and hi[i - 1] != hi[run]:  # else a line and empty ones
                    more.add((lo[run], hi[i - 1]))
                run = i
            if ends:
                if hi[i - 1] != hi[part]:
                    more.add((lo[part], hi[i - 1]))
                part = i
        found = [(a, b) for a, b in [*zip(lo, hi), *sorted(more)] if b - a >= SHINGLE]
        return np.array(found, np.int64).reshape(-1, 2)

    def windows(self, lo: int, hi: int, k: int) -> np.ndarray:
        """Hashes of all k consecutive words of words[lo:hi]."""
        at = np.arange(max(0, hi - lo - k + 1))
        with np.errstate(over="ignore"):
            return _spans(self.hashes[lo:hi], at, at + k, _WORDS)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _least_per_line(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(lines, BANDS * ROWS): the minima of the permuted hashes of grams[lo:hi] of each line."""
    cuts = np.stack([lo, hi], 1).reshape(-1)
    padded = np.append(grams, np.uint64(0))  # an end may be the last place
    if len(padded) <= _AT_ONCE:
        permuted = np.multiply.outer(_MUL, padded)
        permuted += _ADD[:, None]
        return np.minimum.reduceat(permuted, cuts, axis=1)[:, ::2].T
    return np.stack([np.minimum.reduceat(padded * m + a, cuts)[::2] for m, a in zip(_MUL, _ADD)], 1)


def paragraphs(text: str | None) -> tuple[np.ndarray, ...]:
    """Start bytes, end bytes, words, hashes and bands (n, BANDS) of all units."""
    t = Text(text or "")
    lo, hi = t.units().T
    if not len(lo):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), np.zeros((0, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        least = _least_per_line(t.windows(0, len(t.hashes), SHINGLE), lo, hi - SHINGLE + 1).reshape(-1, BANDS, ROWS)
        bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
        for row in range(ROWS):
            bands = _mix(bands * _P + least[:, :, row])
        keys = _spans(t.hashes, lo, hi, _WORDS)
    return t.starts[lo], t.ends[hi - 1], hi - lo, keys, bands


def passages(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes, end bytes and hashes of the chosen windows."""
    t = Text(text or "")
    h = t.windows(0, len(t.hashes), PASSAGE)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    n = min(WINNOW, len(h))
    view = np.ndarray((len(h) - n + 1, n), h.dtype, h, strides=h.strides * 2)
    at = np.arange(len(view)) + view.argmin(1)
    at = at[np.append(True, at[1:] != at[:-1])]  # the first of the least never moves back
    return t.starts[at], t.ends[at + PASSAGE - 1], h[at]


def _slices(batches: Iterator[pd.DataFrame], n: int = 1_000) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), n):
            yield b.iloc[i : i + n]


def _map_paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _slices(batches):
        found = [paragraphs(t) for t in b["text"]]
        n = [len(f[0]) for f in found]
        if sum(n):
            starts, ends, keys, bands = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3, 4))
            yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), n), "h": np.repeat(b["h"].to_numpy(), n), "start": starts, "end": ends, "key": _signed(keys), "bands": list(_signed(bands))})


def _map_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (text, parts) the sorted distinct shingle hashes of each part."""
    for b in _slices(batches):
        out = []
        for text, parts in zip(b["text"], b["parts"]):
            raw = text.encode("utf-8", "surrogatepass")
            for p in parts:
                t = Text(raw[p["start"] : p["end"]].decode("utf-8", "surrogatepass"))
                out.append((p["key"], _signed(np.unique(t.windows(0, len(t.hashes), SHINGLE)))))
        yield pd.DataFrame(out, columns=["key", "grams"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < JACCARD * max(len(a), len(b)):
        return False
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met >= JACCARD * (len(a) + len(b) - met)


def _link(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) that connect what similar paragraphs connect in each block of a bucket, as few as that takes.

    A newcomer is compared with the members of each cluster until one is similar. Many copies are one cluster soon, so cost
    little. Paragraphs that stand in one and the same document alone are not compared."""
    rows = rows.sort_values(["value", "block", "key"])
    where, keys = rows[["value", "block"]].to_numpy(), rows["key"].tolist()
    grams, owners = rows["grams"].tolist(), rows["owner"].tolist()
    cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1), True]).tolist()
    edges = []
    for lo, hi in zip(cuts, cuts[1:]):
        clusters: list[list[int]] = []
        for i in range(lo, hi):
            mine, others = [i], []
            for c in clusters:
                like = next((j for j in c if (owners[i] < 0 or owners[i] != owners[j]) and _similar(grams[i], grams[j])), None)
                if like is None:
                    others.append(c)
                else:
                    edges.append((keys[like], keys[i]))
                    mine = c + mine
            clusters = [*others, mine]
    return pd.DataFrame(edges, columns=["a", "b"])


def _link_across(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges between two blocks of a bucket, of paragraphs that are in different components so far."""
    first = rows["block"].min()
    halves = [rows[rows["block"] == first], rows[rows["block"] != first]]
    a, b = ([h[c].tolist() for c in ("key", "grams", "owner", "root")] for h in halves)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    edges = []
    for key, grams, owner, mine in zip(*a):
        for other, theirs, whose, there in zip(*b):
            if (owner < 0 or owner != whose) and root(mine) != root(there) and _similar(grams, theirs):
                edges.append((key, other))
                parent[root(mine)] = root(there)
    return pd.DataFrame(edges, columns=["a", "b"])


def _map_passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of each text. Of equal windows in a batch only the first document's has to meet the others'; the rest repeat
    it in any case, and are `settled`. So a passage that many documents share is one row of each batch when it is shuffled."""
    for b in _slices(batches, 4_000):
        found = [passages(t) for t in b["text"]]
        n = [len(k) for _, _, k in found]
        if sum(n):
            starts, ends, keys = (np.concatenate([f[i] for f in found]) for i in range(3))
            keys, ids = _signed(keys), np.repeat(b["doc_id"].to_numpy(), n)
            order = np.lexsort((ids, keys))
            new = np.r_[True, keys[order][1:] != keys[order][:-1]]
            first = np.empty_like(order)
            first[order] = order[new][np.cumsum(new) - 1]
            hashes = np.repeat(b["h"].to_numpy(), n)
            yield pd.DataFrame({"doc_id": ids, "h": hashes, "start": starts, "end": ends, "key": keys, "known": ids[first], "known_h": hashes[first], "known_start": starts[first], "settled": ids > ids[first]})


def _map_sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the windows that start at the given bytes the words themselves, and the WINNOW - 1 words on each side, the nearest
    first: hashes, and bytes where a span that takes them in begins or ends."""
    for b in _slices(batches):
        out = []
        for d, h, text, places in zip(b["doc_id"], b["h"], b["text"], b["places"]):
            t, raw = Text(text), text.encode("utf-8", "surrogatepass").lower()
            for at, i in zip(places, np.searchsorted(t.starts, places)):
                left, right = slice(max(0, i - WINNOW + 1), i), slice(i + PASSAGE, i + PASSAGE + WINNOW - 1)
                out.append((d, h, at, b" ".join(raw[at : t.ends[i + PASSAGE - 1]].split()), _signed(t.hashes[left])[::-1], t.starts[left][::-1], _signed(t.hashes[right]), t.ends[right]))
        yield pd.DataFrame(out, columns=["doc_id", "h", "at", "words", "left", "left_at", "right", "right_at"])


def near_paragraphs(lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), keys of different paragraphs, that connect all those of Jaccard JACCARD or more on SHINGLE words that meet in
    a band and stand in different documents.

    Equal paragraphs are one key. Those that meet in a band are a bucket; of buckets with the same members one is compared,
    and each key's shingles are read once from one of its texts. Buckets are compared exactly. One of more than BLOCK keys
    is cut into blocks by hash, another way in every band: comparing inside the blocks connects a large
    group of near copies already, and blocks are compared with one another only in buckets that are not one component then.
    Only verified edges make components; no bucket is gathered in one task, and no pair is left out.
    """
    each = scratch.save(lines.groupBy("key").agg(F.min(F.struct("doc_id", "h", "start", "end")).alias("at"), F.max("doc_id").alias("high"), F.first("bands").alias("bands")))
    # A band's value tells the band too. Most stand alone: those go first, by counts that are combined before the shuffle.
    banded = each.select("key", F.col("at.doc_id").alias("low"), "high", F.explode("bands").alias("value"))
    shared = banded.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    banded = scratch.save(banded.join(merged(shared), "value"))
    members = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"m{i}") for i in range(2)]
    buckets = banded.groupBy("value", "n").agg(*members, F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    buckets = scratch.save(buckets.groupBy("n", "m0", "m1").agg(F.min("value").alias("value")).select("value", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    owner = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1).alias("owner")
    block = F.pmod(F.xxhash64("key", "value"), "blocks").alias("block")
    rows = scratch.save(banded.join(merged(buckets), "value").select("key", owner, "value", "blocks", block))
    scratch.drop(banded)

    wanted = rows.select("key").distinct().join(merged(each), "key").select("key", "at.*")
    wanted = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("key", "start", "end")).alias("parts"))
    ids = docs.select("doc_id", "h", "text")
    texts = ids.join(merged(wanted), (ids.doc_id == wanted._d) & (ids.h == wanted._h)).select("text", "parts")
    grams = scratch.save(texts.mapInPandas(_map_grams, "key long, grams array<long>"))
    scratch.drop(each)
    tasks = max(1, rows.count() // (2 * BLOCK))
    inside = rows.withColumn("_task", F.pmod(F.xxhash64("value", "block"), F.lit(tasks))).join(merged(grams), "key")
    edges = scratch.save(inside.groupBy("_task").applyInPandas(_link, "a long, b long").distinct())

    hot = rows.where("blocks > 1")
    if hot.isEmpty():
        scratch.drop(grams)
        return edges
    roots = connected_components(edges, scratch)
    hot = scratch.save(hot.join(merged(roots), hot.key == roots.node, "left").withColumn("root", F.coalesce("root", "key")).drop("node"))
    mixed = hot.groupBy("value").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("value")
    pairs = hot.join(merged(mixed), "value").withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> _other")
    across = pairs.withColumn("_task", F.xxhash64("value", F.least("block", "_other"), F.greatest("block", "_other"))).join(merged(grams), "key")
    more = scratch.save(across.groupBy("_task").applyInPandas(_link_across, "a long, b long").distinct())
    scratch.drop(grams)
    return edges.union(more)


def _with_runs(spans: DataFrame) -> DataFrame:
    """spans with run, a number that overlapping and adjoining spans of a text share."""
    before = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("new", F.when(F.coalesce(F.max("end").over(before), F.lit(-2)) + 1 >= F.col("start"), 0).otherwise(1))
    run = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("run", F.sum("new").over(run))


def extended(hits: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, first_doc_id, start, end): runs of hits whose outermost windows are the first document's word for word, with the
    words on both sides that it has there too. Were WINNOW more words alike, another window among them would be in the run."""
    outer = _with_runs(hits).groupBy("doc_id", "h", "run", F.col("first.doc_id").alias("first_doc_id"), F.col("first.h").alias("first_h"))
    window = F.struct("start", "end", F.col("first.start").alias("first_at"))
    outer = scratch.save(outer.agg(F.min(window).alias("lo"), F.max(window).alias("hi")))
    edges = outer.select("doc_id", "h", "run", "first_doc_id", "first_h", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("w")).select("doc_id", "h", "run", "first_doc_id", "first_h", "w.*")
    wanted = edges.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("start").alias("at")).union(edges.select("first_doc_id", "first_h", "first_at"))
    wanted = wanted.groupBy("_d", "_h").agg(F.collect_set("at").alias("places"))
    ids = docs.select("doc_id", "h", "text")
    texts = ids.join(merged(wanted), (ids.doc_id == wanted._d) & (ids.h == wanted._h)).select("doc_id", "h", "text", "places")
    sides = texts.mapInPandas(_map_sides, "doc_id long, h long, at int, words binary, left array<long>, left_at array<int>, right array<long>, right_at array<int>")
    sides = scratch.save(sides)
    firsts = sides.select(F.col("doc_id").alias("first_doc_id"), F.col("h").alias("first_h"), F.col("at").alias("first_at"), F.col("words").alias("first_words"), F.col("left").alias("first_left"), F.col("right").alias("first_right"))
    both = edges.join(merged(sides.withColumnRenamed("at", "start")), ["doc_id", "h", "start"]).join(merged(firsts), ["first_doc_id", "first_h", "first_at"]).where("words = first_words")

    def end(side: str, otherwise: str) -> Column:
        alike = F.zip_with(side, f"first_{side}", lambda a, b: F.coalesce(a == b, F.lit(False)))
        differs = F.array_position(alike, False)
        last = F.when(differs > 0, differs - 1).otherwise(F.size(alike)).cast("int") - 1
        return F.when(last >= 0, F.get(f"{side}_at", last)).otherwise(F.col(otherwise))

    return both.groupBy("doc_id", "h", "run", "first_doc_id", "first_h").agg(F.min(end("left", "start")).alias("start"), F.max(end("right", "end")).alias("end")).select("doc_id", "h", "first_doc_id", "start", "end")


def _found(docs: DataFrame, windows: bool, scratch: Scratch) -> DataFrame:
    """The spans of repeats(), not merged yet, with numbers for missing ids. All that runs Python is written within it."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    slim = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned("h", 2) + NO_ID))

    if not slim.groupBy("doc_id", "h").count().where("count > 1").isEmpty():  # rows alike in both are one text from here on
        slim = slim.dropDuplicates(["doc_id", "h"])

    lines = scratch.save(slim.mapInPandas(_map_paragraphs, "doc_id long, h long, start int, end int, key long, bands array<long>"))
    roots = connected_components(scratch.save(near_paragraphs(lines, slim, scratch)), scratch)
    least = lines.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    placed = least.join(merged(roots), least.key == roots.node, "left").withColumn("root", F.coalesce("root", "key"))
    first = placed.groupBy("root").agg(F.min("low").alias("first_doc_id"), F.max("high").alias("last"))
    named = placed.join(merged(first.where("first_doc_id < last")), "root").select("key", "first_doc_id")
    whole = lines.join(merged(named), "key").where("doc_id > first_doc_id").select("doc_id", "h", "first_doc_id", "start", "end")

    if windows:
        chosen = slim.mapInPandas(_map_passages, "doc_id long, h long, start int, end int, key long, known long, known_h long, known_start int, settled boolean")
        spread = F.when(F.col("settled"), F.xxhash64("doc_id", "start"))  # settled rows need no meeting
        least = F.min(F.struct("doc_id", "h", "start")).over(Window.partitionBy("key", "spread"))
        known = F.struct(F.col("known").alias("doc_id"), F.col("known_h").alias("h"), F.col("known_start").alias("start"))
        chosen = chosen.withColumn("spread", spread).withColumn("first", F.when(F.col("settled"), known).otherwise(least))
        return whole.union(extended(chosen.where("doc_id > first.doc_id").select("doc_id", "h", "first", "start", "end"), slim, scratch))
    return whole


def repeats(docs: DataFrame, windows: bool = True) -> DataFrame:
    """(doc_id, h, first_doc_id, start, end): byte spans of texts that repeat what an earlier document has, h the text's
    hash. Earlier is the smaller doc_id; first_doc_id is an earlier document that has it, for paragraphs the first.

    Paragraphs are the units() of a text, its lines first of all; those of different documents linked by Jaccard form components,
    and of each component all but the documents that come first (the smallest doc_id, null last) lose the paragraph. Passages
    repeat word for word, and are left out without `windows`. Repeats inside one document are left. Rows with null doc_id come last, each text of theirs a
    document of its own, in the order of their hashes; doc_ids are below 2 ** 62. Null and empty texts have no spans, an
    empty table no rows; rows of one doc_id are one document, and repeated rows have the same spans. Other columns of docs
    are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    with small_batches(docs.sparkSession):
        found = _found(docs, windows, scratch)
    merged = _with_runs(found).groupBy("doc_id", "h", "run").agg(F.min("first_doc_id").alias("first_doc_id"), F.min("start").alias("start"), F.max("end").alias("end"))
    null = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return merged.select(null("doc_id"), "h", null("first_doc_id"), "start", "end")


def cut(text: Column, spans: Column) -> Column:
    """text without its bytes [start, end) of spans, which are sorted and apart from each other."""
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    kept = F.zip_with(starts, ends, lambda a, b: raw.substr(a + 1, b - a).cast("string"))
    return F.array_join(kept, "")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs whose texts lack the spans of repeats(). All rows and columns stay; texts without repeats stay as they are. A
    column n_chars, if there is one, is brought up to date. Columns that begin with an underscore are left out."""
    docs = own_names(docs)
    found = repeats(docs)
    per = found.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    out = docs.join(merged(per), docs.doc_id.eqNullSafe(per._d) & (F.xxhash64(docs.text) == per._h), "left")
    out = out.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("_cuts"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
