"""Operators against plain Python over small fixtures."""

import collections
import math
import random
import re
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from sqlcheck import DATA  # noqa: E402

import corpus_pipeline  # noqa: E402
from quadmill.llm import common, decontaminate, html_text, licenses, mixing, quality, simhash, substrings, tokens, toxicity, urls  # noqa: E402

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(common.UPPER, common.LOWER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def alnum(t):
    return ALNUM.findall((t or "").translate(LOWER))


# --- components ------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(50)] + [(5, 5)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {v: root(v) for a, b in edges for v in (a, b) if a != b}
    rng.shuffle(edges)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "t")).count() == 0


# --- 1 urls ----------------------------------------------------------------------------------------------------------


def url_models(texts, seeds):
    """Log ratios by dictionaries; texts: {(text, label)}."""
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    symbol = lambda c: "0" if c in "0123456789" else c if c in urls.ALPHABET else "~"

    def grams(t):
        t = "".join(map(symbol, t.translate(LOWER)))
        return [("^" * max(0, urls.ORDER - i) + t[max(0, i - urls.ORDER) : i], t[i]) for i in range(len(t))]

    for t, label in texts:
        counts[label].update(grams(t))
    for t, label in seeds:
        for g in grams(t):
            counts[label][g] += urls.SEED_WEIGHT
    levels = {s: [collections.defaultdict(collections.Counter) for _ in range(urls.ORDER + 1)] for s in counts}
    for s, c in counts.items():
        for (ctx, x), n in c.items():
            for k in range(urls.ORDER + 1):
                levels[s][k][ctx[len(ctx) - k :]][x] += n

    def p(s, ctx, x):
        c = levels[s][0][""]
        q = (c[x] + 1) / (sum(c.values()) + urls.N)
        for k in range(1, urls.ORDER + 1):
            c = levels[s][k][ctx[len(ctx) - k :]]
            n = sum(c.values())
            if n >= urls.MIN_CONTEXT:
                q = (c[x] + len(c) * q) / (n + len(c))
        return q

    return lambda t: (sum(math.log(p("block", c, x) / p("allow", c, x)) for c, x in grams(t)) / len(t)) if t else None


def test_url_scores_and_verdicts(spark):
    rng = random.Random(1)
    rows, hosts = [], ["tion.example", "m.ther.example", "casino-win.example", "blog.free-bets.example", "news.reles.example"]
    for i in range(300):
        rows.append((i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 999)}" + rng.choice(["", "?a=1", "#top", ".html"])))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}

    def rule(host, path):
        best = None
        for name, verdict in urls.RULES:
            h, _, p = name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[0])):
                best = (name, verdict)
        return best

    shown, labelled = {}, set()
    for i, u in rows:
        host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u).groups()
        r = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, r and r[0])
        shown[i] = re.sub(r"\.?[^.]*$", "", host) + re.sub(r"^(/[^/]*){0,1}", "", path)
        labelled.add((shown[i], r[1] if r else "block" if set(re.split("[.-]", host)) & set(urls.REJECTED) else "allow"))
    held = lambda t: (h - (1 << 64) if (h := xxhash.xxh64_intdigest(t.encode(), 42)) >> 63 else h) % 5 == 0
    score = url_models([x for x in labelled if not held(x[0])], [(w + ".", "block") for w in urls.REJECTED] + [(w + ".", "allow") for w in urls.ACCEPTED])
    bins = sorted((math.ceil(score(t) * urls.SCALE - 1e-9) for t, label in labelled if held(t) and label == "allow"), reverse=True)
    limit = max(0.0, next(b for i, b in enumerate(bins) if sum(x >= b for x in bins) > urls.FALSE_REJECTS * len(bins)) / urls.SCALE)
    mean = lambda word: np.mean([score(t) for t in shown.values() if word in t])
    assert min(mean("casino"), mean("bets")) > max(mean("tion"), mean("ther"), mean("reles"))
    for i, _ in rows:
        r = rule(got[i].host, got[i].path)
        if r:
            assert got[i].verdict == r[1] and got[i].score is None
        else:
            assert abs(got[i].score - score(shown[i])) < 1e-9
            assert got[i].verdict == ("block" if score(shown[i]) > limit else "allow")


# --- 2 decontamination -----------------------------------------------------------------------------------------------


def test_decontamination_with_short_items_and_repeats(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words_of(rng, n))) for i, n in enumerate((40, 13, 14, 5, 2, 1, 0, 25))] + [(100, "the the the the the the the the the the the the the the the")]
    rows = []
    for i in range(60):
        w = words_of(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1].split()
            lo = rng.randint(0, max(0, len(t) - 1))
            w[(at := rng.randint(0, len(w))) : at] = t[lo : lo + rng.choice((5, 13, 14, 30))]
        rows.append((i, ("; " if i % 2 else " ").join(w).upper() if i % 3 else ". ".join(w)))
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for r in out.collect():
        w, hit, ids = alnum(r.text), set(), set()
        for item, t in items:
            t = alnum(t)
            k = min(13, len(t))
            for lo in range(len(t) - k + 1 if k else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == t[lo : lo + k]:
                        hit.update(range(at, at + k))
                        ids.add(str(item))
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (len(w), len(hit), len(ids), sorted(ids))
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))


def test_long_documents_with_a_passage_go_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(3)
    items = [(i, " ".join(words_of(rng, n))) for i, n in enumerate((40, 13, 25, 3))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, dirty = {i: words_of(rng, 30 + 40 * i) for i in range(40)}, set()
    for i in range(0, 40, 4):
        w = items[i // 4 % 3][1].split()
        lo = rng.randint(0, len(w) - 13)
        made[i][7:7] = w[lo : lo + 13]
        dirty.add(i)
    made[1][5:5] = items[0][1].split()[:12]  # one word short of a window
    made[2][5:5] = items[3][1].split()  # a short item in 110 words
    made[9][5:5] = items[3][1].split()  # and in 390
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert left == made.keys() - dirty


def test_hits_are_the_same_by_broadcast_and_by_shuffle(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = lambda: sorted(map(str, decontaminate.contamination(docs, bench).drop("text").collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", 0)
    assert rows() == want and not all("n_hit=0" in r for r in want)


# --- 3 simhash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").translate(LOWER).encode().split()
    k = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    t = dict(list(texts.items())[:120]) | {1000 + i: texts[i] + " one more" for i in range(20)} | {2000: "", 2001: None, 2002: "word", 2003: "É A b"}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(list(t.items()), "doc_id long, text string")).collect()}
    prints = {d: plain_fingerprint(x) for d, x in t.items()}
    comp = {d: d for d in t}
    changed = True
    while changed:
        changed = False
        for a in t:
            for b in t:
                if comp[b] < comp[a] and bin(prints[a] ^ prints[b]).count("1") <= 3:
                    comp[a], changed = comp[b], True
    assert got == {d: (f"{prints[d]:016x}", comp[d]) for d in t}
    assert len(set(comp.values())) < len(t)


def test_simhash_links_at_every_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(30)]
    all_ = sorted({b ^ sum(1 << x for x in rng.sample(range(63), k)) for b in base for k in range(5) for _ in range(4)})
    for distance in (1, 2, 3, 5):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in all_], "fp long"), distance).collect()}
        assert got == {(a, b) for a in all_ for b in all_ if a < b and bin(a ^ b).count("1") <= distance}


def test_variants_are_never_broadcast(spark):
    rng = np.random.default_rng(4)
    prints = spark.createDataFrame([(int(f),) for f in rng.integers(-(1 << 63), 1 << 63, 500)], "fp long")
    with common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10MB"):
        found = simhash.links(prints)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_stage_of_near_copies_broadcasts_no_variants(spark, monkeypatch):
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: seen.append(links(*a)) or seen[-1])
    frame = spark.createDataFrame([(i, f"one two three w{i}") for i in range(200)], "doc_id long, text string")
    with common.cleared(), common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10MB"), common.small_batches(spark):
        corpus_pipeline.drop_near_copies(spark, frame, "")
        seen[0].collect()
        assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stage", ["drop_near_copies", "cut_repeats"])
def test_stages_on_pairs_broadcast_no_table(spark, monkeypatch, stage):
    plans, save = [], common.Scratch.save

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(common.Scratch, "save", lambda self, df: save(self, ran(df)))
    monkeypatch.setattr(substrings, "BLOCK", 2)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: 36 + i % 4], f"w{i}"]) + f"\nthis line is only in text {i}") for i in range(12)]
    with common.cleared(), common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10MB"):
        with common.small_batches(spark):
            ran(getattr(corpus_pipeline, stage)(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_one_of_each_keeps_the_smallest(spark, docs):
    twice = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).union(docs.limit(10))
    kept = simhash.one_of_each(twice)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == docs.columns


# --- 4 substrings ----------------------------------------------------------------------------------------------------


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(6)
    passage, para = " ".join(words_of(rng, 55)), " ".join(words_of(rng, 60))
    clean = {i: "\n".join(" ".join(words_of(rng, 40)) for _ in range(3)) for i in range(30)}
    made = dict(clean)
    for i in (31, 32, 33, 40):  # inside a line, between other words
        made[i] = " ".join(words_of(rng, 30)) + " " + passage + " " + " ".join(words_of(rng, 33))
    for i in (51, 52, 53):  # near copies of a paragraph
        w = para.split()
        if i > 51:  # 51 of 61 shingles in common with the first
            w[5 * (i - 50)] = "changed"
        made[i] = " ".join(words_of(rng, 30)) + "\n" + " ".join(w) + "\n" + " ".join(words_of(rng, 30))
    for i in (60, 61):  # over lines
        w = passage.split()[::-1]
        made[i] = " ".join(words_of(rng, 9)) + " " + "\n".join(" ".join(w[j : j + 11]) for j in range(0, 55, 11)) + "\n" + " ".join(words_of(rng, 9))
    df = spark.createDataFrame([(d, t, len(t)) for d, t in made.items()], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert {d: r.text for d, r in out.items() if d < 30} == clean
    for d in (31, 51, 60):
        assert out[d].text == made[d]
    for d in (32, 33, 40, 52, 53, 61):
        assert len(out[d].text) < len(made[d]) - 150 and out[d].n_chars == len(out[d].text)
    for d in (52, 53):
        assert "changed" not in out[d].text and out[d].text.count("\n") == 2
    windows = collections.Counter(w for r in out.values() for w in {" ".join(x[i : i + 40]) for x in [r.text.split()] for i in range(len(x) - 39)})
    assert max(windows.values()) == 1
    found = {(r.doc_id, r.first_doc_id) for r in substrings.repeats(df).collect()}
    assert found == {(32, 31), (33, 31), (40, 31), (52, 51), (53, 51), (61, 60)}


def test_paragraph_components_are_those_of_all_pairs(spark, monkeypatch):
    """Lines of varying likeness, compared pair by pair: what banding finds of the links, and that it makes up none."""
    rng = random.Random(13)
    lines = []
    for _ in range(40):
        w = words_of(rng, rng.randint(12, 50))
        for _ in range(rng.randint(1, 6)):
            x = list(w)
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = f"v{rng.randint(0, 9)}"
            lines.append(x)
    rng.shuffle(lines)
    made = [(i if i % 9 else None, " ".join(lines[i]) + "\n\n" + " ".join(lines[(i * 7 + 3) % len(lines)])) for i in range(len(lines))]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    last = lambda i: (made[i][0] is None, made[i][0] or 0, xxhash.xxh64_intdigest(made[i][1].encode(), 42) >> 2)
    place = {i: n for n, i in enumerate(sorted(range(len(made)), key=last))}
    units = [(place[i], (i, at), t) for i, (_, text) in enumerate(made) for a, b in [text.split("\n\n")] for t, at in ((a, 0), (b, len(a.encode()) + 2))]
    parent = list(range(len(units)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    links = 0
    for x, (i, _, s) in enumerate(units):
        for y, (j, _, t) in enumerate(units[:x]):
            a, b = grams(s), grams(t)
            if s == t or i != j and len(a & b) >= 0.8 * len(a | b):
                links += s != t
                parent[root(x)] = root(y)
    first = {}
    for x, (i, _, _) in enumerate(units):
        first[root(x)] = min(first.get(root(x), i), i)
    want = {at for x, (n, at, _) in enumerate(units) if n > first[root(x)]}
    assert links > 50 and len(want) > 100
    frame = spark.createDataFrame(made, "doc_id long, text string")
    for block in (500, 3):
        monkeypatch.setattr(substrings, "BLOCK", block)
        got = set()
        hashes = {xxhash.xxh64_intdigest(t.encode(), 42): i for i, (_, t) in enumerate(made)}
        for r in substrings.repeats(frame, windows=False).collect():
            i, raw = hashes[r.h % (1 << 64)], made[hashes[r.h % (1 << 64)]][1].encode()
            assert r.doc_id == made[i][0]
            at = r.start
            for part in raw[r.start : r.end].split(b"\n"):
                if part.strip():
                    got.add((i, at))
                at += len(part) + 1
        assert not got - want and len(got & want) >= 0.97 * len(want)


def test_rows_without_id_are_documents_of_their_own(spark):
    rng = random.Random(14)
    passage = " ".join(words_of(rng, 60))
    made = [(None, " ".join(words_of(rng, 20)) + f" {passage} " + " ".join(words_of(rng, 20))) for _ in range(3)]
    spans = substrings.repeats(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert len(spans) == 2 and all(r.doc_id is None and r.first_doc_id is None and r.end - r.start >= len(passage) for r in spans)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 7)
    rng = random.Random(8)
    w = words_of(rng, 120)
    rows = []
    for i in range(40):
        x = list(w)
        x[3 * i] = f"v{i}"
        rows.append((i, " ".join(x)))
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    whole = got.where("start = 0").collect()
    assert {(r.doc_id, r.first_doc_id) for r in whole} == {(i, 0) for i in range(1, 40)}


def test_passages_go_to_their_last_word(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(60):  # 32 words are the shortest that are sure of a window
        n = 32 + i % 20
        passage = " ".join(words_of(rng, n))
        for d in (2 * i, 2 * i + 1):
            before, after = " ".join(words_of(rng, 20) + [f"a{d}"]), " ".join([f"z{d}"] + words_of(rng, 20))
            rows.append((d, f"{before} {passage if d % 2 else passage.upper()} {after}"))
        want.add((2 * i + 1, 2 * i, len(before) + 1, len(before) + 1 + len(passage)))
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id, r.start, r.end) for r in found} == want


def test_short_lines_and_what_they_make_up_count(spark):
    rng = random.Random(10)
    line, wrapped = " ".join(words_of(rng, 10)), words_of(rng, 60)
    other = list(wrapped)
    other[30] = "changed"
    wrap = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, 60, 12))
    prose = lambda: " ".join(words_of(rng, 30))
    rows = [(1, f"{prose()}\n{line}\n{prose()}"), (2, f"{prose()}\n\n{line}\n{prose()}"), (3, f"{prose()}\n\n{wrap(wrapped)}\n\n{prose()}"), (4, f"{prose()}\n{wrap(other)}\n{prose()}"), (5, f"{prose()}\n{' '.join(wrapped)}")]
    cut = {r.doc_id: dict(rows)[r.doc_id].encode()[r.start : r.end].decode() for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut == {2: line, 4: wrap(other), 5: " ".join(wrapped)}


def test_paragraph_recall_and_hashes():
    rng = random.Random(7)
    met = 0
    for _ in range(200):
        w = words_of(rng, 60)
        v = list(w)
        v[30] = "other"  # 56 shingles each, 51 in common: 0.836
        a, b = substrings.paragraphs(" ".join(w)), substrings.paragraphs("first line\n" + " ".join(v))
        met += bool((a[4][0] == b[4][0]).any())
        assert a[3][0] != b[3][0] and substrings.paragraphs("x\n" + " ".join(w).upper())[3][0] == a[3][0]
    assert met >= 196


# --- 5 html ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body><header><h1>Site</h1><a href="/">Home</a></header><nav class="top"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id="cookie-notice">We use cookies, which is a long sentence that has no link in it at all, and goes on for a while.</div>
<main><article><header><h1>The title</h1></header><p>First &lt;b&gt; paragraph&nbsp;of
 the   text, with an <a href="#">inner link</a> in it.<br>More.</p><div class="ad">Buy this thing now, it is a very good thing to buy for all of us.</div>
<aside>Beside the text stands what is not the text.</aside><p>Short.</p><p><b>Bold without an end
<p>Last one &#8212; &eacute; &am</p><form><label>Mail</label><input><button>Send</button></form>
<section id="comments"><h2>Comments</h2><p>I think this is a comment by a reader, and rather long too.</p></section></article></main>
<div class="sidebar"><p>Some words that stand at the side of the page, ten or more of them.</p></div><footer>&copy; 2020 All rights</footer></body></html>"""


def test_finding_units_costs_less_than_reading_the_words():
    rng = random.Random(15)
    texts = ["\n".join(" ".join(words_of(rng, rng.randint(3, 40))) for _ in range(4)) for _ in range(300)]
    read = [substrings.Text(t) for t in texts]

    def seconds(f, given):
        times = []
        for _ in range(5):
            began = time.process_time()
            for x in given:
                f(x)
            times.append(time.process_time() - began)
        return min(times)

    assert seconds(substrings.Text.units, read) < seconds(substrings.Text, texts)


def test_page_parts():
    want = ["The title", "First <b> paragraph of the text, with an inner link in it. More.", "Short.", "Bold without an end", "Last one — é &am"]
    assert html_text.main_text(PAGE).split("\n") == want


def test_pages_without_article_tags_and_broken_ones():
    body = "".join(f"<p>{'word ' * n}</p>" for n in (40, 30, 55))
    links = "<div>" + "".join(f"<p><a href=x>link {i}</a></p>" for i in range(6)) + "</div>"
    got = html_text.main_text(f"<body>{links}<div>{body}</div>{links}</body>")
    assert [len(x.split()) for x in got.split("\n")] == [40, 30, 55]
    for page in (None, "", "<", "<p", "<!-- never", "<script>x", "text <b", "&", "<a href=\"x", "<p class='ad", "<" * 5000, '<a "' * 500):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<article><p>cut off in the mid") == "cut off in the mid"


def nameless(rng):
    """A page of plain divs: blocks of html and whether they are article text."""
    prose = lambda lo, hi: " ".join(words_of(rng, rng.randint(lo, hi)))
    links = lambda n: [(f"<a href=x>{prose(1, 3)}</a>", False) for _ in range(n)]
    out = [(prose(5, 12), False)] * (rng.random() < 0.4) + links(rng.randint(3, 8))
    if rng.random() < 0.6:
        out.append((f"<h1>{prose(5, 12)}</h1>", True))
    for _ in range(rng.randint(3, 9)):
        out.append((prose(25, 120), True))
        if rng.random() < 0.2:
            out.append((prose(3, 9), True))
            out.append((prose(40, 90), True))
        if rng.random() < 0.15:
            out += [(f"<h2>{prose(2, 6)}</h2>", True), (prose(40, 90), True)]
    out += links(rng.randint(0, 6)) + ([(prose(4, 9), False)] if rng.random() < 0.6 else [])
    return out


def test_layouts_without_helpful_names():
    rng = random.Random(15)
    right = total = by_neighbours = 0
    for _ in range(300):
        made = nameless(rng)
        found = html_text.blocks("<body>" + "".join(f"<div>{b}</div>" for b, _ in made))
        assert len(found) == len(made)
        for i, (_, want) in enumerate(made):
            got, asked = html_text.TREE.path(html_text.features(found, i))
            right += got == want
            by_neighbours += bool(set(asked) & set(html_text.NEIGHBOURS))
            total += 1
    assert right >= 0.95 * total and by_neighbours >= 0.5 * total


def test_neighbours_decide():
    links = "".join(f"<div><a href=x>link {i}</a></div>" for i in range(4))
    prose = "".join(f"<div>{'word ' * n}</div>" for n in (60, 45, 80))
    block = "<div>A block of seven words in all.</div>"
    assert "seven" in html_text.main_text(f"<body>{links}{prose}{block}{prose}{links}")
    assert "seven" not in html_text.main_text(f"<body>{links}{block}{links}{prose}{links}")


def test_layout_words_are_no_sidebars():
    prose = "".join(f"<p>{'word ' * n}</p>" for n in (60, 45, 80))
    for wrapper in ("<div class='layout has-sidebar'>", "<div class='no-footer'>", "<div class='sidebar'><article>"):
        assert len(html_text.main_text(f"<body>{wrapper}{prose}").split()) == 185
    assert html_text.main_text(f"<body><article>{prose}</article><div class='sidebar'><p>{'other ' * 30}</p></div>").count("other") == 0


def test_very_long_page():
    page = "<body><nav><a href=x>One</a></nav><article>" + "".join(f"<p>{'word ' * 50}{i}</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999


def test_given_pages(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("raw", ["<svg width='9'/>", "<video src=x />", "<button>", "<button><button>No</button>", "<object data=x>", "<select><option>", "<svg><path/></svg>"])
def test_unclosed_elements_do_not_swallow_the_article(raw):
    before, after = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = html_text.main_text(f"<article><p>{before}</p>{raw}<p>{after}</p></article>")
    assert before in got and after in got



# --- 6 quality -------------------------------------------------------------------------------------------------------


def test_quality_policies_and_ablations(spark, docs):
    led = quality.ledger(docs)
    rows = quality.apply_policy(led, "v2").collect()
    base = quality.apply_policy(led, "v1").where("kept").count()
    assert base >= sum(r.kept for r in rows) > len(rows) / 2
    want = {name: [0, 0] for name, _ in quality.RULES}
    for r in rows:
        for i, (name, _) in enumerate(quality.RULES):
            want[name][0] += r.failed_bits >> i & 1
            want[name][1] += r.failed_bits == 1 << i
    assert {r.rule: [r.n_failed, r.n_only] for r in quality.ablations(led, "v2").collect()} == want


def test_repeated_words(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab c d".split()) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    for r in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = r.text.split()
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))


# --- 7 tokens --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [0, 50, 500_000])
def test_token_counts_are_the_librarys(spark, texts, head):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    odd = ["".join(rng.choice(" ▁ab é\n\t\r\x00<s>漢🙂") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = list(texts.items())[:100] + [(5000 + i, t) for i, t in enumerate(odd)] + [(1, "again"), (1, "again"), (None, None), (2, None), (3, ""), (4, " "), (6, "<s>[INST] </s>")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), head=head).collect())
    n = lambda t: len(sp.encode(t or ""))
    assert got == sorted((d or -1, len((t or "").encode()), n(t), n(t) > 4096) for d, t in rows)


def test_models_whose_pieces_cross_pre_tokens_are_refused(tmp_path):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    model.pieces[5000].piece = "a▁b"
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokens.check_model(str(tmp_path / "m"))


# --- 8 mixing --------------------------------------------------------------------------------------------------------


def test_targets_by_repeated_resharing(spark):
    rng = random.Random(11)
    for n in (1, 2, 3, 7):
        sizes = {f"s{i}": rng.choice((0, 5, 100, 3000, 10)) for i in range(n)} | {None: 40}
        names = sorted([k for k in sizes if k is not None]) + [None]
        w = {k: float(mixing.WEIGHTS[i % 3]) for i, k in enumerate(names)}
        total, target, full = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
        while True:
            free = [k for k in names if k not in full]
            left = total - sum(2.0 * sizes[k] for k in full)
            target = {k: 2.0 * sizes[k] if k in full else left * w[k] / sum(w[x] for x in free) for k in names}
            over = {k for k in free if target[k] > 2 * sizes[k]}
            if not over:
                break
            full |= over
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got.keys() == target.keys() and all(math.isclose(got[k], target[k], abs_tol=1e-6) for k in target)


def test_mix_meets_targets_in_many_bins(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    out = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and r.size == len(r.text.encode().split())
    for rows in by.values():
        assert sum(r.taken for r in rows) == math.floor(rows[0].target + 0.5) and sum(r.size for r in rows) == rows[0].source_size
    monkeypatch.setattr(mixing, "BIN_ROWS", 10**6)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(9)).collect()) == sorted((r.doc_id, r.taken) for r in out)


# --- 9 toxicity ------------------------------------------------------------------------------------------------------


def toxic_corpus(n=1500):
    rng = random.Random(12)
    bad, rows, labels = ["idiotic", "wretch", "scumbag", "vermin"], [], []
    for i in range(n):
        w, y = words_of(rng, rng.randint(20, 60)), int(rng.random() < 0.15)
        for _ in range(3 * y):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "ly", "s"])
        rows.append((i, " ".join(w)))
        if rng.random() < 0.5:
            labels.append((i, 0, y))
    return rows, labels


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rows, labels = toxic_corpus()
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [(got[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (y == 1) for s, y in held) / len(held) > 0.97
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    again = toxicity.train(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again == model
    none = toxicity.train(d, lab.limit(0))
    assert none.weights == {} and toxicity.score(d, none).where("score >= 0.5").count() == 0


def test_risk_stays_non_negative_without_signal():
    rng = np.random.default_rng(2)
    draw = lambda n: [np.unique(rng.integers(0, 500, 40)) for _ in range(n)]
    model = toxicity.fit(draw(60), draw(600), 0.1)
    cache = {}
    assert toxicity._sigmoid(np.array([model.logit("some words", cache)]))[0] < 0.5


# --- 10 licences -----------------------------------------------------------------------------------------------------


def test_license_places_and_labels(spark):
    cases = {
        1: ("Released under the MIT License.", "mit", "mit"),
        2: ("x y Apache LICENSE z mit license", "apache,mit", "apache,mit"),
        3: ("GNU General Public License and general public license", "gpl", "gpl"),
        4: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this great software and associated documentation files (the 'Software'), to deal in the Software without restriction", "", "mit"),
        5: ("All rights reserved.", "", "reserved"),
        6: ("Licensed under CC BY-NC 4.0.", "", "cc-by-nc"),
        7: ("permission is hereby granted to all", "", ""),
        8: ("submit license mitlicense apache-license mit  LICENSE", "apache,mit", "apache,mit"),
        9: ("all rights not reserved under the apache", "", ""),
        10: ("", "", ""),
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in cases.items()], "doc_id long, text string")).collect()}
    for i, (t, base, labels) in cases.items():
        w = alnum(t)
        places = [j for p, _ in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.base_labels, r.labels, r.n_words, r.n_base) == (base, labels, len(w), len(places)), i
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_license_spans_drift_over_inserted_words(spark):
    notice = licenses.TEMPLATES[2][1].split()
    text = " ".join(["before"] * 4 + notice[:9] + ["new", "words"] + notice[9:] + ["after"])
    (a,) = licenses.alignments(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (a.label, a.start, a.end) == ("mit", 4, 4 + len(notice) + 2) and a.score >= 0.8


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_stages_one_by_one(spark, docs, texts, tmp_path):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        had, has = {r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert has.keys() <= had.keys() and (name == "substrings" or all(has[d] == had[d] for d in has))
        if name == "toxicity":
            model = toxicity.train(now, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert has.keys() == {d for d, t in had.items() if toxicity._sigmoid(np.array([model.logit(t, {})]))[0] < 0.5}
        if name == "simhash":
            f = {d: plain_fingerprint(t) for d, t in had.items()}
            assert all(any(bin(f[d] ^ f[k]).count("1") <= 3 for k in had if k != d) for d in had.keys() - has.keys())
            assert not [1 for a in has for b in has if a < b and bin(f[a] ^ f[b]).count("1") <= 3]
        if name == "decontamination":
            wins = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [alnum(r.text)] for i in range(len(w) - 12)}
            dirty = {d for d, t in had.items() for w in [alnum(t)] if any(tuple(w[i : i + 13]) in wins for i in range(len(w) - 12))}
            assert dirty and has.keys() == had.keys() - dirty  # no item here has fewer than 13 words
        if name == "mixing":
            assert all(0 < r.taken <= 2 * r.size for r in out.collect())
        now = out
