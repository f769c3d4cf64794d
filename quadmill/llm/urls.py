"""URL filters: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, own_names

#: 32 symbols: 0 stands before the text, 31 for all that is not listed.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/"
N = 32
ORDER = 3
#: A context counts in a model once it was seen so often there; else a shorter one speaks.
MIN_CONTEXT = 2
#: Part of the accepted held-out URLs that the threshold may reject.
FALSE_REJECTS = 0.02
SCALE = 1000

#: (rule, verdict): the host up to the first slash, then the path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Parts of hosts (between dots and hyphens) that make a URL an example of rejected ones, and parts of good hosts. Each is
#: learned from as SEED_WEIGHT URLs besides.
REJECTED = tuple("casino poker slots bets betting jackpot lottery win pills pharma viagra cialis adult porn xxx sex escort cams loans payday spam ads adserver track tracker clicks popunder replica warez crack torrent phish malware".split())
ACCEPTED = tuple("news blog wiki docs library university school research science museum journal archive forum recipes travel weather books history garden music photo health city sport art film maps data code help community review people magazine".split())
SEED_WEIGHT = 20


@dataclass(frozen=True)
class Models:
    """ratio: (code, value), log-likelihood ratio rejected to accepted of each code; threshold: one row (threshold)."""

    ratio: DataFrame
    threshold: DataFrame


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path. The host stands after the first :// up to a slash, question mark, hash or the end, with A-Z
    lower-cased; the path goes on to a question mark, hash or the end. Null, or no ://: both are empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})


def rule_of(rules=RULES) -> Column:
    """The rule that fits host and path as struct(length, rule, verdict), null if none does. A rule fits its host and all
    hosts below it, where the path begins as the rule's does; the longest rule wins."""
    fits = []
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        here = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits.append(F.when(here & F.startswith(F.col("path"), F.lit(slash + path)), F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits, F.lit(None)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def shown(depth: int) -> Column:
    """What the models read: the host without its last label and the path without its first `depth` segments. What is left
    out is what rules judge whole sites by; with it, the models would only repeat the rules."""
    return F.concat(F.regexp_replace("host", r"\.?[^.]*$", ""), F.regexp_replace("path", rf"^(/[^/]*){{0,{depth}}}", ""))


def grams(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(*keep, code), a row per character: the character and the ORDER before it, five bits each."""
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(text), "[0-9]", "0"), r"[^a-z0./\-]", "~")
    rows = rows.withColumn("_t", plain).where("_t <> ''").withColumn("_c", F.split("_t", ""))
    rows = rows.select(*keep, "_c", F.posexplode("_c").alias("_i", "_x"))
    code = F.lit(0)
    for back in range(ORDER, -1, -1):
        char = F.get("_c", F.col("_i") - back)
        place = F.position(char, F.lit(ALPHABET))
        symbol = F.when(F.col("_i") < back, F.lit(0)).when(place == 0, F.lit(N - 1)).otherwise(place)
        code = code * N + symbol
    return rows.select(*keep, code.cast("int").alias("code"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(code, value) of every code: the log of the ratio of its last symbol's probability after the others, rejected to
    accepted, from counts (code, allow, block).

    Both probabilities are interpolated from one symbol up to ORDER + 1: p = (count + kinds * shorter) / (seen + kinds),
    kinds the number of different symbols seen after the context; a context seen fewer than MIN_CONTEXT times leaves it to
    the shorter one. The tables have N to N ** (ORDER + 1) rows, whatever the corpus.
    """
    sides = ("allow", "block")
    below = None
    for k in range(ORDER + 1):
        size = N ** (k + 1)
        c = counts.groupBy((F.col("code") % size).alias("code")).agg(*[F.sum(x).alias(x) for x in sides])
        grid = counts.sparkSession.range(0, size, 1, max(1, size // 65536)).select(F.col("id").cast("int").alias("code"))
        grid = grid.join(c, "code", "left").fillna(0, list(sides)).withColumn("ctx", F.shiftright("code", 5))
        w = Window.partitionBy("ctx")
        grid = grid.withColumns({f"{x}_seen": F.sum(x).over(w) for x in sides} | {f"{x}_kinds": F.sum((F.col(x) > 0).cast("int")).over(w) for x in sides})
        if below is None:
            below = grid.select("code", *[((F.col(x) + 1) / (F.col(f"{x}_seen") + N)).alias(f"{x}_p") for x in sides])
            continue
        shorter = below.select(F.col("code").alias("short"), *[F.col(f"{x}_p").alias(f"{x}_q") for x in sides])
        grid = grid.join(shorter, F.col("code") % (size // N) == F.col("short"))
        p = lambda x: F.when(F.col(f"{x}_seen") < MIN_CONTEXT, F.col(f"{x}_q")).otherwise((F.col(x) + F.col(f"{x}_kinds") * F.col(f"{x}_q")) / (F.col(f"{x}_seen") + F.col(f"{x}_kinds")))
        below = grid.select("code", *[p(x).alias(f"{x}_p") for x in sides])
    return below.select("code", F.log(F.col("block_p") / F.col("allow_p")).alias("value"))


def scores(rows: DataFrame, ratio: DataFrame, *keep: str) -> DataFrame:
    """(*keep, score): the mean log-likelihood ratio of a text's characters. Distinct texts; empty ones have no row."""
    # The model has N ** (ORDER + 1) rows whatever the corpus: about a million, some 30 MB.
    return grams(rows, F.col("_text"), *keep).join(F.broadcast(ratio), "code").groupBy(*keep).agg(F.avg("value").alias("score"))


def train(judged: DataFrame, scratch: Scratch) -> Models:
    """Models from rows with _text and label (allow or block): all distinct pairs, a fifth of
    which (by hash) is held out to calibrate the threshold, and the seed words."""
    spark: SparkSession = judged.sparkSession
    known = judged.distinct()
    known = known.withColumn("held", F.pmod(F.xxhash64("_text"), F.lit(5)) == 0)
    seeds = spark.createDataFrame([(w + ".", "block") for w in REJECTED] + [(w + ".", "allow") for w in ACCEPTED], "_text string, label string")
    per = lambda rows, weight: grams(rows, F.col("_text"), "label").groupBy("label", "code").agg((F.count("*") * weight).alias("n"))
    counts = per(known.where("NOT held"), 1).union(per(seeds, SEED_WEIGHT))
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    counts = scratch.save(counts.groupBy("code").agg(of("allow").alias("allow"), of("block").alias("block")))
    ratio = scratch.save(log_ratios(counts))
    held = scores(known.where("held AND label = 'allow'"), ratio, "_text")
    bins = held.groupBy(F.ceil(F.col("score") * SCALE).alias("bin")).count()
    above = Window.orderBy(F.desc("bin"))  # bins of a bounded score, some thousands at most
    bins = bins.withColumns({"over": F.sum("count").over(above), "all": F.sum("count").over(Window.partitionBy(F.lit(1)))})
    t = bins.where(F.col("over") > FALSE_REJECTS * F.col("all")).agg(F.max("bin").alias("bin"))
    threshold = t.select(F.greatest(F.coalesce(F.col("bin") / SCALE, F.lit(0.0)), F.lit(0.0)).alias("threshold"))
    return Models(ratio, scratch.save(threshold))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, score.

    Where a rule fits, its verdict holds. All URLs are examples for two character models: of rejected ones, which a rule
    blocks or which have a listed word in their host, and of the others, which count as accepted. A URL that no rule fits is
    blocked where the mean log-likelihood ratio of its characters exceeds the threshold: the score that FALSE_REJECTS of the
    held-out accepted URLs exceed, and at least 0. Null URLs and those without :// have an empty host and path; they, and all
    others without a host, fit no rule, have no score and are allowed. An empty table gives no rows. Repeated rows are judged
    alike; columns of the new names are replaced and those that begin with an underscore left out; other columns aren't shuffled with the characters.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = with_parts(own_names(pages).drop("host", "path", "rule", "verdict", "score")).withColumn("_r", rule_of(rules))
    rows = rows.withColumns({"rule": F.col("_r.rule"), "_label": F.col("_r.verdict")}).drop("_r")
    rows = rows.withColumn("_text", shown(max([rule.count("/") - 1 for rule, _ in rules], default=0)))
    listed = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(x) for x in REJECTED]))
    models = train(rows.where("host <> ''").select("_text", F.coalesce("_label", F.when(listed, "block").otherwise("allow")).alias("label")), scratch)
    score = scores(rows.where("_label IS NULL AND host <> ''").select("_text").distinct(), models.ratio, "_text").withColumnRenamed("_text", "_scored")
    # Decided rows need no score; their keys match none and differ, so that they don't meet in one task.
    key = F.when(F.col("_label").isNull() & (F.col("host") != ""), F.col("_text")).otherwise(F.concat(F.lit("\0"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string")))
    out = rows.join(score, key == F.col("_scored"), "left").drop("_text", "_scored")
    threshold = models.threshold.first()[0]
    verdict = F.coalesce("_label", F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).drop("_label")
