"""The pipeline's stages on planted documents, each against a plain version."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabweave.llm.quality_rules import RATIOS, RULES, STOP_WORDS
from tabweave.llm.queries import tokenizer_path

from .helpers import WORDS, documents, nothing
from .test_near_copies import components_of
from .test_scans import counts


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def planted():
    """(kind, text): clean documents, toxic ones, junk, exact and near copies of clean ones."""
    rng, out = random.Random(4), []
    for _ in range(260):
        out.append(("clean", ". ".join(sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(3, 9))) + "."))
    clean = [t for _, t in out]
    for t in clean[:12]:
        out += [("copy", t), ("copy", t.upper())]
    for t in clean[12:40]:
        words = (t + " " + sentence(rng, 120)).split()
        out.append(("clean", " ".join(words)))
        for _ in range(2):
            k = rng.randrange(len(words) - 2)
            out.append(("near", " ".join([*words[:k], "changed", *words[k + 1 :]])))
    for t in clean[40:110]:
        words = t.split()
        for w in ("you", "idiot", "moron", "stupid"):
            words.insert(rng.randrange(len(words)), w)
        out.append(("toxic", " ".join(words)))
    junk = ["too short to keep", "| a | b | " * 40, "BUY NOW CHEAP " * 30, "the same line again and again of it\n" * 20, "$#%& <<>> ** " * 30, "", None, "zzqq xxyy " * 4 + " ".join(f"nostop{i}" for i in range(60))]
    out += [("junk", t) for t in junk]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows = planted()
    folder = f"file://{tmp_path_factory.mktemp('pipeline')}"
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 7) for i, (_, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k == "toxic")) for i, (k, t) in enumerate(rows) if t], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, folder


def good(text):
    """The table of rules, evaluated in plain Python."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = counts(text)
    if n_words < 20 or 100 * n_repeat_words > 30 * n_words:
        return False
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    capital = lambda w: sum(unicodedata.category(c) == "Lu" for c in w) >= 2 and not any(unicodedata.category(c) == "Ll" for c in w)
    held = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "n_lines": sum(bool(x.strip("\x20\x09\x0a\x0b\x0c\x0d")) for x in text.split("\n")),
        "n_stop_words": sum(w.lower() in STOP_WORDS.split() for w in words),
        "n_capital_words": sum(map(capital, words)),
        "n_echo_words": sum(a == b for a, b in zip(words, words[1:])),
        "n_pipe_words": words.count("|"),
    }
    value = lambda f: held[RATIOS[f][0]] / held[RATIOS[f][1]] if f in RATIOS and held[RATIOS[f][1]] else held.get(f, 0.0)
    return all((r.least is None or value(r.feature) >= r.least) and (r.most is None or value(r.feature) <= r.most) for r in RULES)


def test_stages(spark, data):
    import corpus_pipeline

    rows, folder = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "near_dedup", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == [i for i, (k, _) in enumerate(rows) if k != "toxic"]
    fine = stages["quality_rules"](spark, kept, folder)
    assert fine.columns == docs.columns and ids(fine) == [i for i, (k, t) in enumerate(rows) if k != "toxic" and good(t)]
    assert {i for i, (k, _) in enumerate(rows) if k in ("clean", "near")} <= set(ids(fine)) and not set(ids(fine)) & {i for i, (k, _) in enumerate(rows) if k == "junk"}
    held = {r.doc_id: r.text for r in fine.select("doc_id", "text").collect()}
    order = sorted(held)
    one = stages["near_dedup"](spark, fine, folder)
    assert one.columns == docs.columns and ids(one) == sorted({order[k] for k in components_of([held[i] for i in order])[0].values()})
    assert len(ids(one)) == sum(k == "clean" for k, _ in rows)
    packed = stages["packing"](spark, one, folder)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sum(len(tokenizer.encode(held[i], add_special_tokens=False).ids) + 1 for i in ids(one))
    assert packed.agg(F.sum("length")).first()[0] == want and sorted({r.doc_id for r in packed.select("doc_id").collect()}) == ids(one)
    # the run is the stages one after the other
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == want


def test_stages_on_odd_rows(spark, data):
    """Null and repeated ids, null and empty texts, repeated rows, clashing names, no rows."""
    import corpus_pipeline

    _, folder = data
    for docs in (documents(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= docs.count() or name == "packing"
            assert name == "packing" or out.columns == docs.columns


def test_texts_of_another_type(spark, data):
    import corpus_pipeline

    _, folder = data
    docs = spark.createDataFrame([(1, 5), (2, None)], "doc_id long, text int")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).collect()
