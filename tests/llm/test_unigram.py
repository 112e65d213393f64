"""Unigram encoding against a plain Viterbi over all pieces, and decoding."""

import math
import struct
import zlib

import numpy as np
import pytest

from tabweave.llm.double_array import DoubleArray
from tabweave.llm.queries import tokenizer_path
from tabweave.llm.unigram import BYTE, CONTROL, NORMAL, UNKNOWN, Unigram, encode_documents, read_model

from .helpers import documents, nothing, texts

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    pieces, scores, prefix = read_model(MODEL)
    assert scores is None  # the file at hand has ranks
    return Unigram(pieces, scores, prefix)


def plain(model, text):
    """The greatest sum of scores over whole texts."""
    s = "▁" * model.prefix + text.replace(" ", "▁") if text else ""
    pieces = {p: model.scores[i] for i, (p, kind) in enumerate(model.pieces) if kind == NORMAL}
    longest = max(map(len, pieces))
    best = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - longest), j):
            score = pieces.get(s[i:j])
            if score is None and i == j - 1:
                score = model.unknown_score
            if score is not None:
                best[j] = max(best[j], best[i] + score)
    return best[-1]


def own(model, ids):
    total, run = 0.0, b""
    for i in ids:
        if model.pieces[i][1] == BYTE:
            run += model.text_of[i]
            try:
                run.decode()
            except UnicodeDecodeError:
                continue
            total, run = total + model.unknown_score, b""
        else:
            total += model.scores[i]
    assert run == b""
    return total


def test_scores_are_greatest_and_texts_come_back(model):
    for text in [*[t for t in texts() if t and len(t) < 2000], "  two  blanks ", "line\n\n next", "▁ odd ▁▁mark", "tab\t\x00", " "]:
        ids = model.encode(text)
        assert math.isclose(own(model, ids.tolist()), plain(model, text), abs_tol=1e-6), text
        if "▁" not in text:
            assert model.decode(ids) == text
    assert len(model.encode(None)) == len(model.encode("")) == 0


def test_without_byte_pieces_unknown_characters_are_one_piece():
    m = Unigram([("<unk>", UNKNOWN), ("<s>", CONTROL), ("a", NORMAL), ("ab", NORMAL), ("▁", NORMAL)], [0, 0, -1.0, -1.5, -1.0])
    assert m.encode("ab ééa").tolist() == [4, 3, 4, 0, 2]


@pytest.mark.parametrize("bounds", [(4, 1 << 20), (10**6, 2000)])
def test_little_memory_gives_the_same(model, bounds):
    small = Unigram(model.pieces, None, model.prefix, *bounds)
    assert all((small.encode(t) == model.encode(t)).all() for t in texts() if t and len(t) < 3000)
    small.encode(" ".join(f"{i}x" * 9 for i in range(3000)))
    small.encode("one more")
    assert len(small.young) < 9


def message(*fields):
    return b"".join(bytes([n << 3 | (2 if isinstance(v, bytes) else 5 if isinstance(v, float) else 0)]) + (bytes([len(v)]) + v if isinstance(v, bytes) else struct.pack("<f", v) if isinstance(v, float) else bytes([v])) for n, v in fields)


def test_scores_of_a_unigram_file_are_used(tmp_path):
    pieces = [message((1, b"<unk>"), (2, 0.0), (3, UNKNOWN)), message((1, b"a"), (2, -1.0)), message((1, b"aa"), (2, -2.5))]
    made = lambda *normalizer: message(*((1, p) for p in pieces), (2, message((3, 1))), (3, message(*normalizer)))
    (tmp_path / "m").write_bytes(made((3, 0), (4, 0)))
    found, scores, prefix = read_model(str(tmp_path / "m"))
    assert [p for p, _ in found] == ["<unk>", "a", "aa"] and scores == [0.0, -1.0, -2.5] and not prefix
    assert Unigram(found, scores, prefix).encode("aaa").tolist() == [1, 1, 1]
    (tmp_path / "m").write_bytes(made((2, b"x"), (4, 0)))
    with pytest.raises(ValueError, match="normalized"):
        read_model(str(tmp_path / "m"))


def test_double_array():
    keys = {k.encode(): i for i, k in enumerate(["a", "ab", "abc", "b", "é", "ét", "zz", "\xff", "abd"])}
    trie = DoubleArray(keys)
    for k, i in keys.items():
        assert trie.prefixes(k)[-1] == (i, len(k))
    assert trie.prefixes(b"abx") == [(keys[b"a"], 1), (keys[b"ab"], 2)] and trie.prefixes(b"q") == []
    assert DoubleArray({}).prefixes(b"x") == []


def test_documents(spark, model):
    docs = documents(spark)
    got = sorted(((r.doc_id, r.ids, r.n_bytes, r.decoded) for r in encode_documents(docs, MODEL).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = model.encode(r.text)
        want.append((r.doc_id, ids.tolist(), sum(model.pieces[i][1] == BYTE for i in ids), r.text or ""))
    assert got == sorted(want, key=str)
    assert encode_documents(nothing(spark), MODEL).count() == 0 and zlib.crc32(b"") == 0 and np.dtype("<u2").itemsize == 2
