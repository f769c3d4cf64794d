"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import time
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quadmill.llm import decontaminate, html_text, licenses, mixing, quality, simhash, substrings, tokens, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog near the old mill while seven wise men talk about rain. "
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(20_000))
ROWS = [
    (1, PROSE * 3, "en", "a", 1),
    (1, PROSE * 3, "en", "a", 1),
    (2, None, None, None, None),
    (None, None, None, None, None),
    (None, PROSE, "en", None, 9),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Released under the MIT License.\n" + PROSE, "en", "c", 5),
    (7, "x", "en", "c", 1),
]
CLASH = {"_text": "x", "_h": 1, "_size": 2, "score": "s", "size": "t", "h": 1, "words": "w", "key": 1, "fp": 2, "label": 3, "taken": "u", "kept": "k", "n_words": "v", "labels": "l", "rule": "r", "n_hit": 0}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    item = PROSE.replace("The quick", "Some slow").strip()
    spark.createDataFrame([(1, item), (2, None), (3, "one two"), (None, PROSE), (4, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def operators(spark, folder):
    bench, labels = spark.read.parquet(f"{folder}/benchmark.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return {
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "simhash": simhash.near_duplicates,
        "one_of_each": simhash.one_of_each,
        "repeats": substrings.repeats,
        "without_repeats": substrings.without_repeats,
        "quality": lambda d: quality.apply_policy(quality.ledger(d)),
        "tokens": tokens.count_tokens,
        "mix": mixing.mix,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "licenses": licenses.scan,
    }


NAMES = ["decontaminate", "simhash", "one_of_each", "repeats", "without_repeats", "quality", "tokens", "mix", "toxicity", "licenses"]
AS_MANY = {"decontaminate", "simhash", "without_repeats", "quality", "tokens", "mix", "toxicity", "licenses"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, tables, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    plain = operators(spark, tables)[name](docs)
    rows = plain.collect()
    if name in AS_MANY:
        assert len(rows) == len(ROWS)
    clashing = operators(spark, tables)[name](docs.withColumns({k: F.lit(v) for k, v in CLASH.items()}))
    assert clashing.count() == len(rows)
    same = [c for c in plain.columns if c not in CLASH]
    assert sorted(map(str, clashing.select(same).collect())) == sorted(map(str, plain.select(same).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tables, name):
    assert operators(spark, tables)[name](spark.createDataFrame([], DOCS)).count() == 0


def test_no_items_contaminate_nothing(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, "h"), (None, "no scheme", "h"), (2, "http://A.net/x", None), (2, "http://A.net/x", None), (3, "://", ""), (5, "file:///casino/x", ""), (4, "http://" + "a" * 50_000 + ".org/fr/", "")]])
def test_pages(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"label": F.lit(1), "_text": F.lit(2), "score": F.lit(3), "text": F.lit("t")})
    out = urls.judge(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id == 2:
            assert (r.host, r.path, r.rule, r.verdict) == ("a.net", "/x", "net/", "block")
        if r.page_id in (1, None):
            assert (r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow")
        if r.page_id == 5:
            assert (r.host, r.path, r.rule, r.score, r.verdict) == ("", "/casino/x", None, None, "allow")
    assert [r.text for r in html_text.extract(pages).where("html IS NULL").collect()] == [""] * sum(h is None for _, _, h in rows)


STAGE_CLASH = CLASH | {"had": 1, "had_words": 2, "n_full": 3, "items": "i", "contaminated": "c", "kept0": "z", "_under": 4, "a.b": "dot", "component_id": 5, "source_size": 6, "root": 7}
GIVEN = ("size", "source_size", "target", "taken")


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_alone(spark, tables, rows, name, stage):
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs.withColumns({k: F.lit(v) for k, v in STAGE_CLASH.items()})
    plain, out = stage(spark, docs, tables), stage(spark, wide, tables)
    more = list(GIVEN) if name == "mixing" else []
    assert plain.columns == docs.columns + more
    assert out.columns == [c for c in wide.columns if c not in more] + more
    text = lambda df: sorted(str((r.doc_id, r.text, r.source, r.n_chars)) for r in df.collect())
    assert text(plain) == text(out) and len(text(out)) <= len(rows)
    for r in out.collect():
        assert all(r[k] == v for k, v in STAGE_CLASH.items() if k not in more)
    if rows and name != "mixing":
        kept = [(r.doc_id, r.text) for r in plain.collect()]
        assert kept.count((None, None)) == 1 or (2, None) in kept
        assert kept.count((1, PROSE * 3)) == {"simhash": 1, "decontamination": 0}.get(name, 2) and (5, LONG) in kept  # an item without id is a whole copy of it


def test_pipeline_runs_through(spark, tables):
    began = time.time()
    spark.createDataFrame(ROWS, DOCS).write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    out = corpus_pipeline.run(spark, tables).collect()
    left = [p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir() if p.name.startswith("leaks-") and p.stat().st_mtime > began]
    assert not left  # the operators' tables go when a stage is written
    assert {r.doc_id for r in out} <= {1, 5, 6, 7, None}
    assert all(0 < r.taken <= 2 * r.size for r in out)


def test_scratch_gives_settings_back(spark):
    from quadmill.llm.common import SHUFFLE_CLEANUP, Scratch, setting

    scratch = Scratch(spark, "settings")
    given = spark.conf.get(SHUFFLE_CLEANUP, None)
    saved = scratch.save(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == given
    assert saved.count() == 7 and saved.agg(F.sum("count")).first()[0] == 100
    scratch.clear()
    with pytest.raises(ValueError), setting(spark, SHUFFLE_CLEANUP, "true"):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == given
