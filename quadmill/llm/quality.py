"""Quality rules as a bitmask ledger: each rule is judged once, policies and ablations read the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_names, shingle_hashes, space_words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: (name, SQL predicate over the measurements; true fails). A rule's place is its bit; add new ones at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    ("shouting", "10 * n_upper > 4 * word_chars"),
    ("exclamations", "5 * n_exclamations > n_words"),
)
BASE = ("few_words", "repeated_words")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": tuple(name for name, _ in RULES)}


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """Adds the measurements and failed_bits (bit i set: rule i failed) to every row.

    Null and empty texts have no words and fail few_words. Words stand between runs of ASCII white space. A window is
    WINDOW consecutive words; n_repeat_words counts the words inside windows that the text holds twice or more, the
    first included. Windows are compared by a 64-bit hash of their words' hashes. Columns of the same names are
    replaced, and those that begin with an underscore are left out.
    No shuffle: all is computed within the row, for texts of any length in n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclamations", "failed_bits"]
    out = own_names(docs).drop(*new)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"_h": F.transform(space_words(F.col("text")), lambda w: F.xxhash64(w)), "_lines": lines})
    out = out.withColumn("_w", shingle_hashes(F.col("_h"), WINDOW))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(e: Column, i: Column) -> Column:
        return ((i > 0) & (F.get("_s", i - 1)["h"] == e["h"])) | F.coalesce(F.get("_s", i + 1)["h"] == e["h"], F.lit(False))

    out = out.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twice), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    spaces = "\x20\x09\x0a\x0b\x0c\x0d"
    measured = F.struct(
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
    )
    # Generated, so that a filter on the results stays above and does not measure texts again for every rule it reads.
    kept = [c for c in out.columns if not c.startswith("_")]
    out = out.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(F.array(measured)).alias("_m")).select(*[F.col(f"`{c}`") for c in kept], "_m.*")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    return out.withColumn("failed_bits", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed_bits").bitwiseAND(mask(POLICIES[policy])) == 0)


def ablations(led: DataFrame, policy: str = "v2") -> DataFrame:
    """For every rule of the policy: rows that fail it, and rows that would be kept without it.

    Rows meet as counts by bit pattern, of which there are 2 to the number of rules at most.
    """
    m = mask(POLICIES[policy])
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(m).alias("bits")).count()
    chosen = [(i, name) for i, (name, _) in enumerate(RULES) if m >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in chosen])).alias("r")
    rows = patterns.select("bits", "count", each)
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.expr("bits & r.bit != 0"), F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.expr("bits = r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )
