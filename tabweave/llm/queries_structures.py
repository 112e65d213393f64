"""The queries of the conversation trie, the mix of sources and the Merkle manifest, and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import UPPER, ascii_lower, table

#: DuckDB has no crc32: a byte's step by a table of 256 entries, made here from the polynomial.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def _crc32_sql(digits: str) -> str:
    """crc32 of an ASCII text; the statement has crc_table among its tables."""
    steps = f"list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def decimal_crc32(number: Column) -> Column:
    """Unsigned crc32 of a whole number's decimal digits."""
    return F.crc32(number.cast("long").cast("string").cast("binary"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, root and proof of every document; a fifth of them are held against a text in small letters."""
    from .merkle import leaf_of, prove

    docs = table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    told = F.when(decimal_crc32(F.col("doc_id")) % 5 == 0, leaf_of(*others, ascii_lower(F.col("text"))))
    return prove(docs.select("doc_id", "source", leaf_of(*others, F.col("text")).alias("leaf"), told.alias("claim")))


def _op13_sql(levels: int = 8, top: int = 4) -> str:
    """`levels` and `top`: more than any source's and the sources' tree has here."""
    field = lambda x: f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"  # noqa: E731
    small = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"  # noqa: E731
    tables = [
        _CRC_TABLE,
        f"d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(small)} END AS claim FROM documents, crc_table)",
        "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) AS n FROM d GROUP BY source)",
        "p AS (SELECT d.doc_id, d.leaf, coalesce(d.claim, d.leaf) AS claim, s.i AS s, s.n, row_number() OVER (PARTITION BY s.i ORDER BY d.doc_id NULLS FIRST, d.leaf) - 1 AS i FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source)",
        "a0 AS (SELECT s, i, n, leaf AS h FROM p)",
        "f0 AS (SELECT doc_id, leaf, s, i, n, claim AS h, '' AS proof FROM p)",
    ]
    up = lambda name, own, last: f"SELECT {own} i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{last} GROUP BY {own} i // 16, n"  # noqa: E731
    beside = ", ".join(f"coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (a.i {sign} f.i), '') AS {side}" for sign, side in (("<", "l"), (">", "r")))
    for k in range(levels):
        tables.append(f"a{k + 1} AS ({up('a', 's,', k)})")
        tables.append(f"o{k} AS (SELECT f.*, {beside} FROM f{k} f JOIN a{k} a ON a.s = f.s AND a.i // 16 = f.i // 16 GROUP BY ALL)")
        tables.append(f"f{k + 1} AS (SELECT doc_id, leaf, s, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(l || h || r) ELSE h END AS h, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof FROM o{k})")
    tables.append(f"b0 AS (SELECT s AS i, count(*) OVER () AS n, h, h AS subroot FROM a{levels})")
    tables.append(f"g0 AS (SELECT f.doc_id, f.leaf, b.subroot, b.i, b.n, f.h, f.proof FROM f{levels} f JOIN b0 b ON b.i = f.s)")
    for k in range(top):
        tables.append(f"b{k + 1} AS ({up('b', '', k)})")
        tables.append(f"q{k} AS (SELECT f.*, {beside} FROM g{k} f JOIN b{k} a ON a.i // 16 = f.i // 16 GROUP BY ALL)")
        tables.append(f"g{k + 1} AS (SELECT doc_id, leaf, subroot, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(l || h || r) ELSE h END AS h, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof FROM q{k})")
    return "WITH " + ",\n".join(tables) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = b.h AS verified FROM g{top} g, b{top} b"


def rebuilt_sequences(sequences: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 20, then its own after the first h; h is crc32(c) % 4."""
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = sequences.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (decimal_crc32(F.col("conv_id")) % 4).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice("head", F.lit(1), h)
    both = sequences.withColumn("base", base).join(heads, "base", "left")
    return both.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(head, own)).alias("turns"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the beginning of another."""
    from .conversation_trie import prefix_trie, turn_sequences

    return prefix_trie(rebuilt_sequences(turn_sequences(table(spark, sf_dir, "conversations"))))


_OP11_SQL = rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT o.*, {_crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM o, crc_table),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ended FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM c)),
n AS (
    SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN k[1:d - 1] END AS up,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^ 	-]+')) END AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
    FROM p GROUP BY k, d
),
m AS (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up) x ON x.up = n.k),
s AS (
    SELECT k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1
)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN n u ON u.k = m.up"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of their sources by weights 3, 1, 2 at one and a half times their words, none more than twice."""
    from .mixing import mix_documents

    mixed = mix_documents(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


_OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[:15])::BIGINT AS h
    FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([3.0, 1.0, 2.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM d GROUP BY source),
c AS (
    SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
        sum(w) OVER (ORDER BY 2 * source_size / w DESC, source DESC) AS weights
    FROM s
),
r AS (SELECT coalesce((SELECT (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - held) / weights FROM c WHERE held + 2 * source_size / w * weights >= 1.5 * (SELECT sum(source_size) FROM s)::DOUBLE ORDER BY 2 * source_size / w, source LIMIT 1), 'inf'::DOUBLE) AS rate),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, rate * w) AS target FROM s, r),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS copies FROM t),
p AS (SELECT d.*, b.source_size, b.target, b.copies, b.words - b.copies * b.source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p"""


QUERIES = {"op11_trie": op11_trie, "op12_mixing": op12_mixing, "op13_merkle": op13_merkle}
ORACLE_SQL = {"op11_trie": _OP11_SQL, "op12_mixing": _OP12_SQL, "op13_merkle": _op13_sql()}
