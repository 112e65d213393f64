"""Rows of one id and different texts."""

from tabweave.llm.simhash import keep_one

from .helpers import documents


def test_repeated_ids_of_different_texts(spark):
    a, b, c = "a b c d e f", "other words that stand here", "third text of quite other words"
    docs = documents(spark, [(1, a), (1, b), (2, b), (3, a), (4, c), (5, c), (4, a)], extra=False)
    assert sorted((r.doc_id, r.text) for r in keep_one(docs).collect()) == [(1, a), (1, b), (4, c)]
