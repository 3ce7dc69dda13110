"""Language, toxicity and main text: held-out accuracy, exact neighbours, awkward rows."""

import random
import time
import zlib

import numpy as np
import pytest
from brookspan.llm import html_text as H
from brookspan.llm import language as L
from brookspan.llm import toxicity as X
from pyspark.sql import functions as F

LEARN = lambda: F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = L.identify(docs, LEARN()).join(docs.select("doc_id", "lang"), "doc_id").where(~LEARN()).collect()
    assert len(found) > 40 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(odd_documents, no_documents):
    found = L.identify(odd_documents, LEARN()).collect()
    assert len(found) == odd_documents.count()
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {60, 61, 62} == und and {r.lang_pred for r in found} == {"und", "en"}
    assert {r.lang_pred for r in L.identify(odd_documents, F.lit(False)).collect()} == {"und"}
    assert L.identify(no_documents, LEARN()).count() == 0


def test_language_rejects_what_is_far_away(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en") for i in range(20)] + [(99, "zzqx vvkj qqpw xxzz jjkv", None)]
    found = {r.doc_id: r.rejected for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert found[99] and not found[0]


def toxic_table(spark):
    source = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdfglm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(500):
        text = [source.choice(words) for _ in range(source.randint(5, 60))]
        if bad := i % 6 == 0:
            for _ in range(source.randint(1, 4)):
                text.insert(source.randrange(len(text)), source.choice(["Rotten", "vile!", "VILENESS"]))
        rows.append((i, " ".join(text), "toxic"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "toxic"), (1001, "", "toxic"), (None, "vile rotten", "toxic"), (3, rows[3][1], "toxic")]
    labels += [(None, 1, 1), (2, 1, None), (4, 1, 0), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = toxic_table(spark)
    learning = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    found = X.score_toxicity(docs, labels, learning).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 80 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    by = {r.doc_id: r for r in found}
    assert by[None].predicted == 1 and by[None].evidence and not by[1000].predicted and by[1000].score == by[1001].score
    clean = X.without_toxic(docs, labels, learning)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in found if not r.predicted}
    assert {r.score for r in X.score_toxicity(docs, labels, F.lit(False)).collect()} == {0.0}
    assert X.score_toxicity(docs.limit(0), labels, learning).count() == 0


def test_toxic_terms_beside_stronger_ones_have_neighbours(spark):
    source = random.Random(6)
    clean = lambda: " ".join(source.choice(["bread", "water", "stone", "river", "green"]) for _ in range(12))
    rows = [(i, clean() + (" rotten vile foul" if i < 96 else ""), int(i < 96)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, "water foul river"), (901, "water rotten river"), (902, "water vile river"), (903, "green stone")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    found = {r.doc_id: r for r in X.score_toxicity(docs, labels, F.lit(True)).collect()}
    assert all(found[i].predicted and found[i].evidence for i in (900, 901, 902)) and not found[903].predicted


def test_labels_outside_the_learning_rows_change_nothing(spark):
    docs, labels = toxic_table(spark)
    learning = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    turned = labels.withColumn("toxic", F.when(learning, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in X.score_toxicity(docs, x, learning).collect()} for x in (labels, turned))
    assert a == b


def test_labels_by_chance_give_scores_near_their_rate(spark):
    source = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfglm" for b in "aeiou" for c in "nrst"]
    rows = [(i, " ".join(source.choice(words) for _ in range(30)), int(source.random() < 0.15)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = X.score_toxicity(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"), F.lit(True)).collect()
    assert np.mean([r.predicted for r in found]) < 0.05 and abs(np.mean([r.score for r in found]) - 0.15) < 0.05


def test_block_bounds_keep_the_neighbours_exact():
    random_ = np.random.default_rng(4)
    rows = [{int(p): int(random_.integers(1, 5)) for p in random_.choice(40, random_.integers(0, 6), replace=False)} for _ in range(700)]
    toxic = random_.integers(0, 2, 700).astype(float)
    model = X.Neighbours([f"t{i}" for i in range(40)], np.arange(700), rows, toxic, np.ones(700), 10)
    dense = np.zeros((len(model.ids), 40))
    for n, i in enumerate(model.ids):
        for p, v in model._unit(rows[i]).items():
            dense[n, p] = v
    for query in rows[:80]:
        if query:
            unit = model._unit(query)
            vector = np.zeros(40)
            vector[list(unit)] = list(unit.values())
            scores = dense @ vector
            want = sorted(((-s, n) for n, s in enumerate(scores.tolist()) if s > 0))[:10]
            got = model.nearest(unit)
            assert np.allclose([s for s, _ in got], [-s for s, _ in want]) and len(got) == len(want)


def test_isotonic_is_non_decreasing():
    at, value = X.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert (np.diff(value) >= 0).all() and np.interp(0.4, at, value) == 1 and np.interp(0.25, at, value) == 0.5


PAGE = (
    '<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy <b>this</b> now.</div><article><h1>Heading</h1><p><b>First &eacute;\n  para graph, of the text.<br><p>Second one.</p><p>Sh is.</p></article>'
    '<div class="comments"><p>Nice text, thank you very much.</p></div><footer>&copy; site'
)


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "plain < text & more"), (4, "x", "<p>" * 500), (5, "y", "<div class='a' " + "x" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = H.main_text(df, written=150).collect()
    assert len(found) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in found}
    assert texts[1, "u"] == "Heading\nFirst é para graph, of the text.\nSecond one.\nSh is."
    assert texts[2, None] == "" and texts[None, "v"] == "" and texts[4, "x"] == ""
    assert H.main_text(df.limit(0), written=150).count() == 0


def test_main_text_of_unseen_written_pages():
    model, source, right = H.fit(300), random.Random(77), 0
    for _ in range(60):
        marked, _ = H.written_page(source)
        page = marked.replace("", "").replace("", "")
        places = H.nodes(H.parse(marked))
        truth = H.labelled(places)
        blocks = {}
        for node, label in zip(places, truth, strict=True):
            if label == H.MAIN:
                for block, text in node.pieces:
                    blocks.setdefault(block, []).append(text)
        lines = (H._SPACE.sub(" ", "".join(blocks[b])).strip() for b in sorted(blocks))
        right += model.texts([page])[0] == "\n".join(x for x in lines if x)
    assert right >= 48


def test_labels_never_contradict():
    source = random.Random(1)
    for _ in range(50):
        page, _ = H.written_page(source)
        all_ = H.nodes(H.parse(page))
        logs = np.log(np.random.default_rng(source.randrange(99)).dirichlet(np.ones(3), len(all_)))
        label = dict(zip(map(id, all_), H.decoded(all_, logs), strict=True))
        for node in all_:
            if node.parent and label[id(node.parent)] != H.MIXED:
                assert label[id(node)] == label[id(node.parent)]


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


PARAGRAPHS = [f"The {a} of the old town was {b} in the summer, and people came from far away to see it, again and again." for a, b in (("bridge", "repaired"), ("market", "opened"), ("library", "moved"))]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
LAYOUTS = [
    page(f"<header>Site name</header><nav><a href='/'>Home</a></nav><article><h1>Old town news of the year</h1>{ARTICLE}<aside>Read also: other story.</aside></article><footer>Imprint</footer>"),
    page(f"<div id='nav' class='menu'><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div><div class='article-body'><h1>Old town news of the year</h1>{ARTICLE}</div><div class='comments'><h3>Comments</h3><div class='comment'><p>I liked it.</p></div></div>"),
    page(f"<form id='page'><nav><a href='/'>Home</a></nav><main><h1>Old town news of the year</h1>{ARTICLE}</main><footer>Imprint</footer></form>"),
    page(f"<main class='content'><h1>Old town news of the year</h1>{ARTICLE}<form><label>Mail</label><input></form></main><aside class='related'><ul><li><a href='/x'>More</a></li></ul></aside>"),
]


@pytest.mark.parametrize("at", range(len(LAYOUTS)))
def test_hand_written_layouts(spark, at):
    """What stands in navigation, asides, footers and forms goes, and every paragraph of the article stays."""
    df = spark.createDataFrame([(1, "u", LAYOUTS[at])], "page_id long, url string, html string")
    lines = H.main_text(df).first().text.split("\n")
    assert lines[-3:] == PARAGRAPHS and set(lines[:-3]) <= {"Old town news of the year"}


def test_long_pages_take_time_in_proportion():
    extractor = H.fit()
    for n in (2000, 8000):
        began = time.process_time()
        extractor.texts(["<article>" + "<p>Some words of an article that goes on.</p>" * n + "</article>"])
        took = time.process_time() - began
    assert took < 8
