"""Boosted trees, calibration, toxicity, WARC records and the pipeline."""

import random

import numpy as np
import pytest

from tabweave.llm.boosting import fit_isotonic, fit_trees
from tabweave.llm.html_text import page_text
from tabweave.llm.toxicity import FEATURES, Lexicon, drop_toxic, features, fit_toxicity, score_toxicity

from .helpers import WORDS, documents, nothing


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (((x[:, 0] > 0.3) ^ (x[:, 1] > 0)) & (rng.random(3000) < 0.95)).astype(float)
    model = fit_trees(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    curve = fit_isotonic(model.raw(x[2000:]), y[2000:])
    assert (np.diff(curve(np.linspace(-5, 5, 99))) >= 0).all()
    assert fit_isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])).value.tolist() == [0, 0.5, 0.5, 1]
    assert fit_trees(x[:5], np.zeros(5)).raw(x[:3]).shape == (3,)


def corpus(n=500):
    rng = random.Random(2)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(rng.randint(15, 60))]
        toxic = i % 7 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorbalu", "zorbali", "zorbaxen", "moron"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity(spark):
    rows = corpus()
    docs = documents(spark, [(i, t) for i, t, _ in rows], extra=False)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(1, None), (None, 1), (9999, 1), (1, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert any(t.startswith("zorb") for t in model.lexicon.terms)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.97
    odd = documents(spark)
    scores = score_toxicity(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    kept = drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() > 0
    assert drop_toxic(nothing(spark), model).count() == score_toxicity(nothing(spark), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(0, 0), (1, 0)], [(12345, 1)]])
def test_toxicity_without_labels(spark, rows):
    docs = documents(spark, [(0, "a b c"), (1, "you idiot")], extra=False)
    model = fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert drop_toxic(docs, model).count() == 2


def test_features():
    x = dict(zip(FEATURES, features("You IDIOT! you are 1d1ot-like", (Lexicon(), False))[0], strict=True))
    assert x["near_second_person"] > 0 and x["masked_lexicon"] >= 1 and x["fixed_per_word"] > 0 and x["capitals"] > 0.2
    assert len(features(None, (Lexicon(), True))[0]) == len(FEATURES)


def test_page_text():
    page = '<html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- <p>no --><script>var a="</p>";</script><p>One&nbsp; two<br>three<a href=\'/x?a=1&amp;b\' >l</a><td>c</td> 1 < 2 <b>x</b></p><SCRIPT>never closed'
    assert page_text(page) == ("One two\nthreel c 1 < 2 x", "T & t", ["/x?a=1&b"])
    assert page_text("") == ("", "", []) and page_text("<p>open <a href=") == ("open <a href=", "", [])


@pytest.mark.parametrize("unit", ["<a ", "<a x='", '<a "', "<!", "</", "<svg ", "<a b=c <"])
def test_tags_that_never_end_take_linear_time(unit):
    import time

    began = time.perf_counter()
    page_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 2
