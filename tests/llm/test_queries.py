"""The registered queries on the smallest tables: columns, whole results, SQL twins."""

import duckdb
import pytest

from tabweave.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score template containment",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_unigram": "doc_id n_pieces n_bytes ids decoded_crc32",
    "op5_warc": "page_id record_type record_id refers_to target_uri date content_type content_length block_digest source_digest block",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_va_topk": "query_id rank vec_id score",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_mixing": "doc_id size source_size target taken",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    key = df.columns[0]
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{ {'page_id': 'pages', 'query_id': 'embeddings', 'conv_id': 'conversations'}.get(key, 'documents') }.parquet").select({"query_id": "vec_id"}.get(key, key)).collect()}
    found = {r[key] for r in rows}
    assert found <= ids if key == "conv_id" else found == ({i for i in ids if i % 50 == 0} if key == "query_id" else ids)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        result = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(str([r[c] for c in df.columns]) for r in rows) == sorted(str([r[columns.index(c)] for c in df.columns]) for r in result.fetchall())
