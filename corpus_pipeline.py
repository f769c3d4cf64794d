"""From raw documents to a training mix: five stages, each over all that the one before kept.

Every stage keeps whatever columns its input has, under any names, and gives them back as they were; only cut_repeats
changes text and n_chars. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.llm import decontaminate, mixing, simhash, substrings, toxicity
from quadmill.llm.common import BATCH, BATCH_SETTING, Scratch, aside, cleared, small_batches

#: Any word, between ASCII white space.
WORD = r"[^\x20\x09-\x0D]"


def _lasting_small_batches(spark: SparkSession) -> None:
    """Python workers get BATCH rows at once from here on: what a stage returns runs after the stage's function. run() sets it back."""
    spark.conf.set(BATCH_SETTING, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, scores below 0.5.

    Null and empty texts have the score of a text without features, the class prior's at most, and stay; rows without id are
    scored like any other. Equal texts have equal scores, so repeated rows stay or go together. Without labels all stay.
    """
    _lasting_small_batches(spark)
    docs, back = aside(docs, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(docs, model).where("score < 0.5"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id, null last; among equal ids the one with the
    smallest text hash, and one of rows that are alike in both. All null and empty texts are copies of each other."""
    _lasting_small_batches(spark)
    docs, back = aside(docs, "doc_id", "text")
    return back(simhash.one_of_each(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs and passages that a document of smaller doc_id has; those left without a word go.

    Rows that have no word to begin with stay, null texts among them. Rows of one doc_id are one document and do not repeat
    each other; rows without id come last, each a document of its own. n_chars, if there, is brought up to date.
    """
    docs, back = aside(docs, "doc_id", "text", "n_chars")
    out = substrings.without_repeats(docs.withColumn("had", F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
    return back(out.where(~F.col("had") | F.col("text").rlike(WORD)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any whole window (13 words) of a benchmark item, however long they are; of items too short for a
    window less than a twentieth of the words may be theirs, since few words meet by chance.

    Null and empty texts have no words and stay. Repeated rows stay or go together. Without items all stay.
    """
    docs, back = aside(docs, "doc_id", "text")
    return back(decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_full = 0 AND NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken; columns of those names are replaced.

    Null and empty texts have no words, so they go. Null source is a source of its own. Rows of one source with one
    doc_id stand as one in the order; which is taken at the cut does not depend on the run.
    """
    docs, back = aside(docs.drop("size", "source_size", "target", "taken"), "doc_id", "text", "source")
    out = mixing.mix(docs).where("taken > 0")
    names = ["size", "source_size", "target", "taken"]
    return back(out, *names)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier, the components and the MinHash bands have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    last = None
    for _, stage in STAGES:
        with cleared(), small_batches(spark):
            out = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        docs = last = out
    return docs
