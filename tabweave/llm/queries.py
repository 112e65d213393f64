"""The queries of this folder's operators and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_structures
from .shared import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document by unigram Viterbi, and whether they decode to its text."""
    from .unigram import encode_documents

    rows = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record in WARC files; their metadata and conversion records, in files of their own, read back."""
    from .warc import derive_files, page_responses, read_derivatives, write_responses

    responses = write_responses(page_responses(table(spark, sf_dir, "pages")))
    return read_derivatives(spark, derive_files(spark, responses))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded, written as token-id files and read back."""
    from .token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    from .quality_rules import quality

    q = F.col("quality")
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    )


def _op7_sql() -> str:
    from .quality_rules import CAPITALS, RATIOS, RULES, STOP_WORDS

    checks = []
    for rule in RULES:
        value = rule.feature
        if value in RATIOS:
            of, by = RATIOS[value]
            value = f"coalesce({of}::DOUBLE / nullif({by}, 0)::DOUBLE, 0.0)"
        checks += [f"{value} >= {rule.least}"] if rule.least is not None else []
        checks += [f"{value} <= {rule.most}"] if rule.most is not None else []
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
win AS (SELECT doc_id, i, w[i:i + 7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1)
    GROUP BY doc_id
),
c AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '{CAPITALS}'))) AS n_capital_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo_words, len(list_filter(w, lambda x: x = '|')) AS n_pipe_words
    FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(checks)} AS kept FROM f"""


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, width=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    from .license_scan import PHRASES, THRESHOLD, sought
    from .license_texts import TEMPLATES

    lists = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    phrases = ", ".join(f"({lists(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, '{t.label}', {lists(t.tokens)}, {lists(t.must)}, {t.need}, {t.step}, {list(t.kin)}::INTEGER[])" for k, t in enumerate(sought(TEMPLATES, THRESHOLD)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES {phrases}),
t(template, label, tokens, must, need, step, kin) AS (VALUES {templates}),
hits AS (SELECT doc_id, label, i - 1 AS word FROM (SELECT doc_id, w, label, phrase, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, p) WHERE w[i:i + len(phrase) - 1] = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY 1),
pairs AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM d),
b AS (SELECT doc_id, step, start, list_distinct(g[start + 1:start + 2 * step - 1]) AS held FROM (SELECT doc_id, step, g, unnest(range(0, n, step)) AS start FROM pairs, (SELECT DISTINCT step FROM t))),
m AS (SELECT doc_id, step, start, template, label, kin, need, len(list_intersect(held, must)) = len(list_distinct(must)) AS told, len(list_intersect(held, tokens)) AS n, len(tokens) AS total FROM b JOIN t USING (step)),
h AS (SELECT *, n / total AS share FROM m WHERE n >= need),
k AS (SELECT * FROM h WHERE told OR NOT EXISTS (SELECT 1 FROM h y WHERE y.doc_id = h.doc_id AND y.step = h.step AND y.start = h.start AND y.told AND list_contains(h.kin, y.template))),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, list({{'share': share, 'label': label}} ORDER BY share DESC, label DESC)[1] AS best FROM k GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(f.labels, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(f.best.share, 0) END::DOUBLE AS score, f.best.label AS template, coalesce(f.best.share, 0)::DOUBLE AS containment
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN f USING (doc_id)"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes; equal texts share a shard."""
    from .sharding import shard_documents

    rows = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every 50th vector among all others."""
    from .va_topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model of op9 sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels of those not held out."""
    from .toxicity import THRESHOLD, fit_toxicity, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from .simhash import hex_fingerprint, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_unigram": op4_unigram,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_va_topk": op8_va_topk,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
} | queries_structures.QUERIES

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _op2_sql(),
    "op7_quality_rules": _op7_sql(),
    "op8_va_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5""",
} | queries_structures.ORACLE_SQL
