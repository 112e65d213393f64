"""Texts that aren't UTF-8: every operator reads their bad bytes as U+FFFD."""

import pytest
from pyspark.sql import functions as F

from tabweave.llm.conversation_trie import turn_sequences
from tabweave.llm.license_scan import scan_licenses
from tabweave.llm.merkle import leaf_of
from tabweave.llm.mixing import mix_documents
from tabweave.llm.near_copies import keep_one_copy, near_copies
from tabweave.llm.packing import pack_documents
from tabweave.llm.quality_rules import keep_good, quality
from tabweave.llm.queries import tokenizer_path
from tabweave.llm.sharding import shard_documents
from tabweave.llm.simhash import near_duplicates
from tabweave.llm.token_files import read_token_files, write_token_files
from tabweave.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity
from tabweave.llm.unigram import encode_documents

BAD = [b"a good word \xff\xfe and \xc3 more", b"\x80", b"fine text of words", b"cut \xe2\x82", "né".encode() + b"\xed\xa0\x80 end"]


@pytest.fixture(scope="module")
def both(spark):
    """The same texts with bad bytes, and with what stands for them."""
    bad = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(BAD)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit("s").alias("source"))
    mended = bad.withColumn("text", F.make_valid_utf8("text"))
    texts = [r.text for r in mended.orderBy("doc_id").collect()]
    assert texts[0] == "a good word �� and � more" and texts[2] == "fine text of words" and texts[3] == "cut �"
    return bad, mended


OPERATORS = {
    "op1": lambda d: pack_documents(d, tokenizer_path(), end_id=2).drop("sequence_id", "offset"),
    "op2": scan_licenses,
    "op3": lambda d: shard_documents(d, 2),
    "op4": lambda d: encode_documents(d, tokenizer_path("piece_bpe_32k.model")),
    "op6": lambda d: read_token_files(d.sparkSession, write_token_files(d, tokenizer_path(), end_id=1)),
    "op7": quality,
    "op9": lambda d: score_toxicity(d, fit_toxicity(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
    "op10": near_duplicates,
    "near copies": near_copies,
    "op12": mix_documents,
    "turns": lambda d: turn_sequences(d.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), "text", F.col("text").alias("role"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_bad_bytes_are_read_as_replacement_characters(both, name):
    bad, mended = (sorted(map(str, OPERATORS[name](d).drop("text", "row").collect())) for d in both)
    assert bad == mended and len(bad) >= len(BAD)


def test_filters_keep_the_bytes(both):
    bad, _ = both
    kept = [keep_one_copy(bad), keep_good(bad, rules=()), drop_toxic(bad, fit_toxicity(bad, bad.select("doc_id", F.lit(0).alias("toxic"))))]
    for df in (kept[0], kept[2]):
        assert sorted(bytes(r.b) for r in df.select(F.col("text").cast("binary").alias("b")).collect()) == sorted(BAD)


def test_leaves_hash_the_bytes_themselves(both):
    bad, mended = ([r[0] for r in d.select(leaf_of(F.col("text"))).collect()] for d in both)
    assert [a == b for a, b in zip(bad, mended, strict=True)] == [False, False, True, False, False]
