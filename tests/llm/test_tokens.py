"""Token ids, packing and token files against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabweave.llm import word_ids
from tabweave.llm.elias_fano import EliasFano
from tabweave.llm.packing import PackingCosts, best_cuts, pack_documents, with_hard_places
from tabweave.llm.queries import tokenizer_path
from tabweave.llm.token_files import TokenFile, read_token_files, write_token_files
from tabweave.llm.word_ids import WordIds

from .helpers import documents, nothing, texts

PATH = tokenizer_path()
ODD = ["don't stop.'S İX ΑΣ. été <|endoftext|>abc, <|startoftext|> a\x1cb a\x85b a\xa0b  x", "K Å ﬁ Ⅷ a,b.c;d e.. f,' 's 't-x don't,", " .,;\n\t\r x", "́abc ̈", "ẞ ſ ŉ x.!?", "a" * 3000, *texts()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("most", [4, 10**6])
def test_word_ids_are_the_tokenizers(tokenizer, most):
    store = WordIds(PATH, most)
    made = [*ODD, *ODD]
    for text, alone, (ids, ends) in zip(made, store.ids(made), store.bounded(made), strict=True):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(alone, store.kind).tolist() == want
        assert ids.tolist() == want and (ends.tolist() == sorted(set(ends.tolist()))) and (not want or ends[-1] == len(want))


def test_word_ids_of_odd_letters_and_special_tokens(tokenizer):
    rng = random.Random(5)
    atoms = ["\u0130", "\u0149", "\u01f0", "\u201c", "\u201d", "\u2019", "\u2014", "\u015e\u0130RKET\u0130", "abc", "ABC", "don", "'s", "'S", *".,!?", "<|EndOfText|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "\n", *"    ", "\t", "\r", "\u0307", "\u0301", "\u00c9", "\u1e9e", "\u03a3", "\u042f", "\u65e5", "\ufb01", "\u212a", "\u212b", "1", "\xa0", "\x85", "\u02b0", "\u01c5", "\u1c80", "\uac00", "\u1100", "\u1161", "\U0001f600", "\U00010400", "\u0345", "abc. ", "de, ", "x.. ", "\u201d. ", "\u0130. ", "\u0130, ", "\xb2. ", "1. ", "_. ", "\x1c. ", "\u0301. ", "\u0531. ", ".\n", ",\n", "\u03c2; "]
    made = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    want = [x.ids for x in tokenizer.encode_batch_fast(made, add_special_tokens=False)]
    for store in (WordIds(PATH), WordIds(PATH, 40), WordIds(PATH, 10**6, 20_000)):
        for at in range(0, len(made), 50):
            part = made[at : at + 50]
            for text, ids, alone, (again, _) in zip(part, want[at : at + 50], store.ids(part), store.bounded(part), strict=True):
                assert np.frombuffer(alone, store.kind).tolist() == ids == again.tolist(), text
        assert store.most_bytes > 10_000 or len(store.young) < 2000


class Counted(dict):
    """A dictionary that counts what is looked up in it."""

    n = 0

    def get(self, *key):
        self.n += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.n += 1
        return super().__getitem__(key)


@pytest.mark.parametrize("way", ["ids", "bounded"])
def test_a_word_is_looked_up_once_for_all_its_places(tokenizer, way):
    store, made = WordIds(PATH), ["One two, three. Fünf, élan; \n" * 500, "two three!! " * 500]
    store.young = Counted(store.young)
    got = [np.frombuffer(x, store.kind) if way == "ids" else x[0] for x in getattr(store, way)(made)]
    assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in made]
    assert store.young.n < 100


def test_plain_words_go_to_the_merges_alone(tokenizer):
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xDF, 0x100)) if c != 0xF7]
    rng = random.Random(3)
    made = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(200)) for _ in range(100)] + [" ".join(a + b for a in letters for b in letters)]
    store, asked = WordIds(PATH), []
    store._ids = lambda texts: asked.extend(texts) or [np.asarray(x.ids, store.kind) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, store.kind).tolist() for x in store.ids(made)] == [x.ids for x in tokenizer.encode_batch_fast(made, add_special_tokens=False)]
    assert not asked


def test_ends_of_sentences_and_lines(tokenizer):
    text = ". A b.\n\nc! d ,e? f.g\té. ×. \x0b. h"
    (ids, ends), (none, no_ends), (again, same) = WordIds(PATH).bounded([text, None, text + "."])
    until = ["", ".", ". A b.", ". A b.\n\nc!", ". A b.\n\nc! d ,e?", ". A b.\n\nc! d ,e? f.g\té.", ". A b.\n\nc! d ,e? f.g\té. ×.", ". A b.\n\nc! d ,e? f.g\té. ×. \x0b.", text]
    assert ends.tolist() == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in until[1:]]
    assert len(none) == len(no_ends) == 0 and same.tolist() == [*ends.tolist()[:-1], len(again)] and len(again) == len(ids) + 1


def test_cuts_keep_to_sentences_where_they_can():
    costs = PackingCosts()
    places, penalties = with_hard_places(np.array([700, 4700, 5000, 10_000]), np.array([8, 8, 0, 0]), 4096, costs)
    assert places.tolist() == [700, 4700, 5000, *range(5512, 10_000, 512), 10_000] and penalties.tolist() == [8, 8, 0, *[64] * 9, 0]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 511, 512, 513, 2000):
        for top in (1, 9, 5000, 1 << 40):
            values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
            coded = EliasFano.of(values)
            again = EliasFano(coded.n, coded.low_bits, *coded.sections())
            assert (again.values() == values).all() and [again.select(i) for i in range(n)] == values.tolist()
    dense = EliasFano.of(np.cumsum(rng.integers(1, 900, 10_000)).astype(np.uint64))
    assert dense.nbytes * 8 / 10_000 < 2 + np.log2(900) + 1
    with pytest.raises(IndexError):
        dense.select(10_000)


def test_token_files_round_trip(spark, tokenizer):
    docs = documents(spark)
    files = write_token_files(docs, PATH, end_id=1, file_ids=500)
    assert len(files.files) > 3
    got = read_token_files(spark, files).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    at, last = 0, -1
    want = defaultdict(list)
    for r in rows:
        want[r.doc_id].append(whole(tokenizer, r.text, 1).tobytes())
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and bytes(r.ids) in want[r.doc_id]
        want[r.doc_id].remove(bytes(r.ids))
        at += r.n_tokens
        assert (-1 if r.doc_id is None else r.doc_id) >= last
        last = -1 if r.doc_id is None else r.doc_id
    first = TokenFile(files.files[0][0])
    assert [first.document(i)[2].tolist() for i in range(len(first))] == [ids.tolist() for _, _, ids in first.documents()]
    none = write_token_files(nothing(spark), PATH, end_id=1)
    assert none.files == [] and read_token_files(spark, none).count() == 0


def test_best_cuts_cost_least():
    rng = random.Random(2)
    for _ in range(200):
        width = rng.choice([8, 16, 32])
        costs = PackingCosts(rng.randint(0, 3), rng.randint(2, 6), rng.randint(0, 4), rng.randint(2, width), (2, 4, 8))
        places = np.cumsum([rng.randint(1, 2 * width) for _ in range(rng.randint(1, 30))])
        places, penalties = with_hard_places(places, np.array([rng.choice([0, costs.sentence]) for _ in places]), width, costs)
        p, extra = [0, *places.tolist()], [0, *penalties.tolist()]
        padding = lambda n: 0 if n in costs.unpadded else width - n
        best = [0]
        for j in range(1, len(p)):
            best.append(min(best[i] + extra[j] + costs.sequence + padding(p[j] - p[i]) for i in range(j) if p[j] - p[i] <= width))
        cuts, cost = best_cuts(places, penalties, width, costs)
        assert cost == best[-1] and cuts[-1] == p[-1]
        at = dict(zip(p, extra, strict=True))
        assert sum(at[b] + costs.sequence + padding(b - a) for a, b in zip([0, *cuts], cuts)) == cost


@pytest.mark.parametrize(("width", "block"), [(64, 300), (4096, 1 << 20)])
def test_packing_holds_every_id_once(spark, tokenizer, width, block):
    docs = documents(spark)
    got = pack_documents(docs, PATH, end_id=2, width=width, block=block).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length * 4 == len(r.ids)
            at += r.length
        assert at <= width
    ids = sorted(zlib.crc32(whole(tokenizer, r.text, 2).tobytes()) for r in docs.select("text").collect())
    starts = sorted((r.sequence_id, r.offset, r.start, bytes(r.ids), r.doc_tokens) for r in got)
    found, held = [], b""
    for _, _, start, part, total in starts:  # a document's pieces follow one another in order of the sequences
        assert start * 4 == len(held)
        held += part
        if len(held) == 4 * total:
            found.append(zlib.crc32(held))
            held = b""
    assert held == b"" and sorted(found) == ids
    assert pack_documents(nothing(spark), PATH, end_id=2).count() == 0


def test_little_padding(spark):
    docs = documents(spark, [(i, " ".join(f"w{i * k % 97} some words." for k in range(40))) for i in range(400)], extra=False).coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = pack_documents(docs, PATH, end_id=2).groupBy("sequence_id").sum("length").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = sum(r[1] for r in got)
    assert sum(4096 - r[1] for r in got) - 4096 < 0.01 * total


def test_token_files_hold_the_same_ids_however_texts_are_cut_up(spark, tokenizer, monkeypatch):
    made = [*ODD, None, "", "A b. Été, c!\n" * 40] * 3
    want = [tokenizer.encode(x or "", add_special_tokens=False).ids for x in made]
    for chunk, run in ((1, 1), (50, 3), (5000, 64)):
        monkeypatch.setattr(word_ids, "CHUNK", chunk)
        monkeypatch.setattr(word_ids, "RUN", run)
        store = WordIds(PATH, 40)
        assert [np.frombuffer(x, store.kind).tolist() for x in store.ids(made)] == want
        assert [x.tolist() for x, _ in store.bounded(made)] == want
    same = documents(spark, [(i, "One two, three. Fünf, élan; \n" * (i % 7)) for i in range(300)], extra=False)
    got = {r.doc_id: bytes(r.ids) for r in read_token_files(spark, write_token_files(same, PATH, end_id=1)).collect()}
    assert got == {r.doc_id: whole(tokenizer, r.text, 1).tobytes() for r in same.collect()}


def test_new_words_are_encoded_in_pieces(tokenizer):
    class Counted:
        def __init__(self, own):
            self.own, self.most = own, 0

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, sum(len(x.split()) for x in texts))
            return self.own.encode_batch_fast(texts, **options)

    store = WordIds(PATH)
    store.tokenizer, store.plain = Counted(store.tokenizer), Counted(store.plain)
    spelt = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(5000)]
    made = " ".join([*spelt, *("é" + w for w in spelt), *("я" + w for w in spelt), *(f"x{w}9-{w}" for w in spelt)])
    (ids,) = store.ids([made])
    assert np.frombuffer(ids, store.kind).tolist() == tokenizer.encode(made, add_special_tokens=False).ids
    assert 0 < store.plain.most <= 1 << 11
    assert 0 < store.tokenizer.most <= 1 << 11
