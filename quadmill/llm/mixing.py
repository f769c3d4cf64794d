"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, own_names, space_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Documents in a bin of the key range, about; a large source is cut into as many bins as that takes.
BIN_ROWS = 2_000


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the word count and the random key of every row. The key is an md5 of doc_id, so reruns agree on any cluster."""
    return docs.withColumns(
        {
            "_size": F.size(space_words(F.col("text"))).cast("long"),
            "_key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))),
        }
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row a source, adds each source's target in words.

    Weights repeat over the sources in code point order, null last. A source takes max_epochs times its size at most;
    what it can't take goes to the others by weight. In closed form: with sources in the order of size / weight, all
    before some place are at their limit and the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), rank + 1)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    out = sources.withColumns({"_w": w, "_cap": F.col("source_size") * float(max_epochs)})
    out = out.withColumns(
        {
            "_left": F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_w_left": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    out = out.withColumn("_full", F.col("_cap") * F.col("_w_left") <= F.col("_left") * F.col("_w"))
    rate = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_left", "_w_left"))).over(every)
    out = out.withColumn("_rate", rate)
    level = F.col("_rate._left") / F.col("_rate._w_left") * F.col("_w")
    return out.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(level, F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """Adds to every row size, source_size, target and taken (the words of it that the mix takes, repeats counted).

    Rows of a source stand in the order of a hash-random key. Its whole epochs take every word; the rest of its budget
    takes rows from the front, and the row at the cut gives only its first words, so a source meets its target to a
    word. Rows of one source that have the same doc_id share a key and stand as one; one at the cut is shared out evenly, rounded down. A source whose texts have no word takes none. Null text has size 0; null source
    is a source of its own. Clashing columns of those names are replaced; an empty table gives no rows.
    Columns that begin with an underscore are left out.

    Only keys, sizes and sources are shuffled, never texts: bins of the key range get prefix sums, those locate the cut key
    of every source, and the rows compare themselves with it.
    """
    docs = own_names(docs).drop("size", "source_size", "target", "taken")
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save(with_size(docs, seed).groupBy("source", "_key").agg(F.sum("_size").alias("words"), F.count("*").alias("n")))
    sources = scratch.save(targets(slim.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("_rows")), weights, share, max_epochs).withColumn("_budget", F.round("target").cast("long")))
    plan = sources.withColumns(
        {
            "_epochs": F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long"),
            "_rest": F.when(F.col("source_size") > 0, F.col("_budget") % F.col("source_size")).otherwise(F.lit(0)),
        }
    )
    # Keys are uniform, so equal parts of their range hold about equally many rows.
    n_bins = F.least(F.lit(1 << 20), F.greatest(F.lit(1), F.ceil(F.col("_n") / BIN_ROWS))).cast("long")
    per_source = slim.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n")).select("_s", n_bins.alias("_bins"))
    keyed = slim.join(per_source, slim.source.eqNullSafe(per_source._s)).drop("_s")
    keyed = keyed.withColumn("bin", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_bins"), 32))
    bins = keyed.groupBy("source", "bin").agg(F.sum("words").alias("words"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    cut_bin = bins.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    cut_bin = cut_bin.where("before <= _rest AND _rest < before + words").select(F.col("b.source").alias("_s"), F.col("bin").alias("_b"), "before", "_rest")
    inside = keyed.join(cut_bin, keyed.source.eqNullSafe(cut_bin._s) & (F.col("bin") == F.col("_b")))
    run = F.coalesce(F.sum("words").over(Window.partitionBy("source", "bin").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = inside.withColumn("_start", F.col("before") + run).where("_start <= _rest AND _rest < _start + words")
    cuts = cuts.select("_s", F.col("_key").alias("_cut"), F.expr("(_rest - _start)").alias("_more"), F.col("words").alias("_of"), F.col("n").alias("_n"))
    plan = scratch.save(plan.join(cuts, plan.source.eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_src"), "source_size", "target", "_epochs", "_cut", "_more", "_of", "_n"))
    scratch.drop(slim)
    scratch.drop(sources)
    rows = with_size(docs, seed)
    rows = rows.join(plan, rows.source.eqNullSafe(plan._src), "left")
    at_cut = F.when(F.col("_n") == 1, F.col("_more")).otherwise(F.expr("_more * _size div greatest(_of, 1)"))
    extra = F.when(F.col("_key") < F.col("_cut"), F.col("_size")).when(F.col("_key") == F.col("_cut"), at_cut).otherwise(F.lit(0))
    rows = rows.withColumn("taken", F.least(F.col("_epochs") * F.col("_size") + F.coalesce(extra, F.lit(0)), F.col("_size") * max_epochs))
    return rows.withColumnRenamed("_size", "size").drop("_key", "_src", "_epochs", "_cut", "_more", "_of", "_n")
