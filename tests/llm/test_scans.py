"""Licence scans and quality rules against plain Python."""

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabweave.llm.license_scan import PHRASES, SHORT, THRESHOLD, scan_licenses
from tabweave.llm.license_texts import TEMPLATES, Template
from tabweave.llm.quality_rules import Rule, keep_good, quality

from .helpers import documents, nothing, texts

GPL = "This work is licensed under the GNU General Public License, version 3."
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
MIT = TEMPLATES[0].text
APACHE = next(t.text for t in TEMPLATES if t.label == "apache-2")
BODY = MIT.replace("files", "papers").replace("sublicense, ", "").replace("KIND", "sort")
LICENSED = [
    "Under the MIT-license, under the mit license under the MIT license! CC BY-NC cc by nc",
    "Apache License, Version 2.0 x",
    "x " * 500 + GPL + " y" * 99,
    "y " * 40 + GPL,
    "é Released under the MIT License.",
    "released under some other license",
    "under the mit \u212a license, licensed under the GNU General Public \u212aicense, version 3",
    CC.format(""),
    CC.format("-NonCommercial"),
    CC.format("-ShareAlike"),
    CC.format("-NonCommercial-ShareAlike"),
    "z " * 77 + BODY + " z" * 400,
    "Copyright me.\n" + MIT[: len(MIT) // 2],
]


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def pairs_of(w):
    return set(zip(w, w[1:]))


def scanned(doc_id, text):
    w = plain(text)
    at, base = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    sizes = [len(plain(t.text)) for t in TEMPLATES]
    hits = defaultdict(list)
    for t, n in zip(TEMPLATES, sizes):
        step, tokens = max(x for x in sizes if (x <= SHORT) == (n <= SHORT)), pairs_of(plain(t.text))
        for i in range(0, len(w), step):
            held = pairs_of(w[i : i + 2 * step])
            if len(held & tokens) >= math.ceil(THRESHOLD * len(tokens) - 1e-9):
                hits[step, i].append((t, tokens, len(held & tokens) / len(tokens), all(pairs_of(plain(m)) <= held for m in t.must)))
    related = lambda a, b: 2 * len(a & b) >= min(len(a), len(b))
    kept = [(share, t.label) for found in hits.values() for t, tokens, share, told in found if told or not any(other.must and yes and other is not t and related(tokens, theirs) for other, theirs, _, yes in found)]
    share, label = max(kept, default=(0.0, None))
    more = base | {x for _, x in kept}
    return doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(more)), 1.0 if at else share, label, share


def test_license_scan(spark):
    docs = documents(spark, list(enumerate([*texts(), *LICENSED])))
    got = sorted(map(tuple, scan_licenses(docs).collect()), key=str)
    assert got == sorted((scanned(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    assert scan_licenses(nothing(spark)).count() == 0
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_related_licences_are_told_apart(spark):
    want = {CC.format(""): "cc-by", CC.format("-NonCommercial"): "cc-by-nc", CC.format("-ShareAlike"): "cc-by-sa", CC.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa", GPL.replace("3", "2"): "gpl-2", GPL: "gpl-3", "a " * 50 + BODY: "mit", "Released under the MIT Licence": "", APACHE.replace("(the \"License\")", "(the \"Licence\")"): "apache-2", APACHE.replace("Apache License", "Apache Licence"): "apache-2"}
    docs = documents(spark, list(enumerate(want)), extra=False)
    assert {r.doc_id: r.labels for r in scan_licenses(docs).collect()} == dict(enumerate(want.values()))


def test_every_whole_text_is_found_wherever_it_starts(spark):
    made = [(i, "x " * (37 * i + k) + t.text + " y" * (11 * i)) for i, t in enumerate(TEMPLATES) for k in range(3)]
    got = {(r.doc_id, x) for r in scan_licenses(documents(spark, made, extra=False)).collect() for x in r.labels.split(",")}
    assert {(i, t.label) for i, t in enumerate(TEMPLATES)} <= got
    own = scan_licenses(documents(spark, [(1, "one two three four five"), (2, "one three two")], extra=False), {}, [Template("own", "two three four", ("three four",))])
    assert sorted((r.doc_id, r.labels, r.score) for r in own.collect()) == [(1, "own", 1.0), (2, "", 0.0)]
    assert [r.labels for r in scan_licenses(documents(spark, [(1, "one")], extra=False), {}, []).collect()] == [""]


def counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = list(enumerate([*texts(), "a b c d e f g h " * 300, "x\x1cy z\x85 q", "|a|\n|a|\n \n \nq", "one two three four five six seven eight nine one two three four five six seven eight " * 2]))
    docs = documents(spark, rows)
    for r in quality(docs.drop("quality")).select("text", "quality.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed)
    assert quality(nothing(spark)).count() == 0


def test_quality_keeps_whole_rows(spark):
    good = " ".join(f"the word{i} of it" for i in range(20))
    docs = documents(spark, [(1, good), (2, "short"), (3, good.upper()), (4, " ".join(f"w{i}%" for i in range(50))), (5, good)])
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 5]
    assert kept.select("`a.b`").distinct().collect() == [(7,)]
    assert keep_good(docs, [Rule("n_words", least=10_000)]).count() == 0
    assert keep_good(nothing(spark)).count() == 0
    assert not re.search("Python|Pandas|Arrow", quality(docs.drop("quality")).where(F.col("quality.kept"))._jdf.queryExecution().executedPlan().toString())
