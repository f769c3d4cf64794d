"""SimHash near-duplicates: fingerprints, one-wildcard segment variants, equality join, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import LOWER, UPPER, Scratch, connected_components, merged, own_names

SHINGLE = 3
DISTANCE = 3
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose bits are unpacked at once.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed integer: a bit is 1 where more than half of the shingles' XXH64 (seed 42) have it. No words: 0.

    Words stand between ASCII white space, which is what bytes.split() splits at; A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    line = b" ".join(words)
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        hashes = np.array([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts[lo : min(lo + _BLOCK, n)], ends[lo + k - 1 : lo + k - 1 + _BLOCK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints of column fp that differ in `distance` bits at most.

    The 64 bits are cut into distance // 2 + 1 segments, so that one of them differs in one bit at most: with 3 bits,
    two segments of 32. Each fingerprint is indexed under every variant of each segment with one bit left out; two of them
    are close enough only if they meet in a variant. Keys are (segment, bit, value); the join keeps verified pairs alone.
    It is merged at any size: Spark takes the variants to be as small as the fingerprints and would broadcast them.
    """
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    variants = [(lo, hi, bit) for lo, hi in zip(edges, edges[1:]) for bit in range(lo, hi)]
    masks = [((1 << hi) - (1 << lo)) & ~(1 << bit) for lo, hi, bit in variants]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = prints.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("variant", "value"))
    a, b = merged(rows).alias("a"), merged(rows).alias("b")
    met = a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance))
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _groups(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, h the text's hash; (fp, root) of every fingerprint."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(docs.select("doc_id", F.xxhash64("text").alias("h"), fingerprints("text").alias("fp")))
    nodes = rows.select("fp").distinct()
    roots = connected_components(scratch.save(links(nodes, distance)), scratch)
    return rows, nodes.join(merged(roots), nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links, its own included; rows with a null doc_id take part and
    get the smallest id of their component, or null. Null and empty texts have fingerprint zero and link like any other.
    Exact copies share a fingerprint, so they are one node; they never make pairs.
    """
    rows, groups = _groups(docs, distance)
    placed = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(merged(groups), "fp")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(merged(ids), "root").select("fp", "component_id")
    return rows.join(merged(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's (null last), among equal ids the smallest text hash's.
    Texts are shuffled once, to meet the chosen rows, and where rows repeat in both once more, to keep one."""
    docs = own_names(docs)
    rows, groups = _groups(docs, distance)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")
    least = rows.groupBy("fp").agg(F.min(order).alias("first")).join(merged(groups), "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = least.select(F.col("first.doc_id").alias("_d"), F.col("first.h").alias("_h"))
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    out = hashed.join(merged(chosen), hashed.doc_id.eqNullSafe(chosen._d) & (hashed._text == chosen._h), "left_semi")
    if not rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_text"])
    return out.drop("_text")
