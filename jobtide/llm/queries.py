"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jaccard import jaccard_components
from .knn import top_k
from .langid import identify
from .licenses import BLOCK_WORDS, PHRASES, STRIDE, TEMPLATES, THRESHOLD, scan, word_set
from .neardup import near_duplicates
from .packing import pack_documents
from .pieces import round_trip
from .pii import digest, find_pii
from .suffix import cleaned
from .tokens import count_tokens

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with a checksum of each piece's ids instead of the ids."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=85, words=4)


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_ngram_jaccard, op3_embedding_neardup, op4_exact_knn, op5_token_counts, op6_license_scan, op7_pii, op8_sentencepiece, op9_suffix_dedup, op10_language_id
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)"


def _list(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _license_sql() -> str:
    phrases = [(f"p{i}", p.split(), label) for i, (p, label) in enumerate(sorted(PHRASES.items(), key=lambda x: x[1]))]
    places = ", ".join(f"list_filter(range(0, greatest(len(w) - {len(ws) - 1}, 0)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws)) + f") AS {c}" for c, ws, _ in phrases)
    named = "list_filter([" + ",".join(f"CASE WHEN len({c}) > 0 THEN '{label}' END" for c, _, label in phrases) + "], lambda x: x IS NOT NULL)"
    held = []
    for label, t in TEMPLATES.items():
        words = word_set(t)
        held.append(f"SELECT rn, '{label}' AS label, len(list_intersect(b, {_list(words)})) / {len(words)}.0::DOUBLE AS c FROM blocks WHERE len(list_intersect(b, {_list(words)})) >= {-(-THRESHOLD * len(words) // 1)}")
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
blocks AS (SELECT rn, list_distinct(w[f + 1:f + {BLOCK_WORDS}]) AS b FROM (SELECT rn, w, unnest(range(0, greatest(len(w) - {STRIDE}, 1), {STRIDE})) AS f FROM d)),
quoted AS (SELECT rn, list(DISTINCT label) AS quoted, max(c) AS c FROM ({" UNION ALL ".join(held)}) GROUP BY 1),
p AS (SELECT rn, doc_id, len(w) AS n_words, {places} FROM d), q AS (SELECT rn, doc_id, n_words, {"|| ".join(c for c, *_ in phrases)} AS every, {named} AS named FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word, array_to_string(named, ',') AS base_labels,
array_to_string(list_sort(list_distinct(named || coalesce(quoted, []))), ',') AS labels, CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score FROM q LEFT JOIN quoted USING (rn)"""


#: DuckDB SQL for the queries that SQL can express. At the correctness size op3's trees are single leaves, so its links are all links.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))), {_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM s LEFT JOIN least_of ON a = doc_id""",
    "op3_embedding_neardup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95), {_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept FROM v LEFT JOIN least_of l ON l.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op4_exact_knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op6_license_scan": _license_sql(),
}
