"""Queries of operators 1, 2, 4, 6, 7 and 10 to 13, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import best_fit, byte_bpe, conversation_repair, html_extract, line_dedup, near_dedup, quality, suffix_decontam, vector_codes
from corpusloom.storage import materialize

#: The tokenizer definition that op2 uses; any byte-level definition can be given to the operator.
TOKENIZER = "byte_bpe_50k.json"
#: The ranks that op12 uses; their pattern is their package's.
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_definition(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:  # the driver's file; workers get its content
        return f.read()


def op1_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    got = html_extract.page_texts(spark.read.parquet(f"{d}/pages.parquet"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    pieces = materialize(best_fit.token_pieces(docs, tokenizer_definition()), "pieces")
    return best_fit.pack_pieces(pieces)[0].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Four-word shingles, as the contract says."""
    return near_dedup.near_groups(spark.read.parquet(f"{d}/documents.parquet"), words=4, percent=80)


def op7_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet")))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return suffix_decontam.contamination_digest(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_digest(spark.read.parquet(f"{d}/documents.parquet"))


def op11_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.code_digest(spark.read.parquet(f"{d}/embeddings.parquet"))


def op12_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(RANKS), "rb") as f:  # the driver's file; workers get its content
        bpe = byte_bpe.ByteBpe(f.read(), public_tokenizers.PATTERN)
    return byte_bpe.encoded_digest(spark.read.parquet(f"{d}/documents.parquet"), bpe)


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return conversation_repair.repair_digest(spark.read.parquet(f"{d}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_best_fit_packing, op4_near_dedup, op6_decontamination, op7_quality_classifier, op10_line_dedup,
        op11_vector_codes, op12_byte_bpe, op13_conversation_repair,
    )
}

_WHITE = r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LEAST = line_dedup.MIN_WORDS
# c: cut units; n: normalised ones; u: units, equal ones in a row as one; e: entries (k: 0 alone, 1 with the next unit);
# r: repeated entries; g: units that go; z: spans.
_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     c AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i
           FROM (SELECT doc_id, string_split(regexp_replace(t, '({line_dedup.ENDS})', '\\1' || chr(1), 'g'), chr(1)) AS p FROM d)),
     n AS (SELECT doc_id, i, sum(length(x)) OVER w AS b, (sum(length(x)) OVER w) - length(x) AS a, trim(regexp_replace(lower(x), '{_WHITE}', ' ', 'g')) AS norm
           FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
     m AS (SELECT *, CASE WHEN norm = lag(norm) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM n WHERE norm <> ''),
     f AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM m),
     u AS (SELECT doc_id, q, norm, min(a) AS a, max(b) AS b, greatest(len(string_split(norm, ' ')), length(norm) // {line_dedup.CHARS_A_WORD}) AS words FROM f GROUP BY doc_id, q, norm),
     e AS (SELECT doc_id, q, 0 AS k, norm AS key FROM u WHERE words >= {_LEAST}
           UNION ALL SELECT doc_id, q, 1, norm || chr(10) || after FROM (SELECT *, lead(norm) OVER (PARTITION BY doc_id ORDER BY q) AS after FROM u) WHERE after IS NOT NULL),
     r AS (SELECT doc_id, q, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first, row_number() OVER (PARTITION BY key, doc_id ORDER BY q) AS again FROM e) WHERE doc_id > first OR again > 1),
     h AS (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS run FROM r WHERE k = 1),
     j AS (SELECT doc_id, run, min(q) AS a, max(q) + 1 AS b FROM h GROUP BY doc_id, run),
     g AS (SELECT doc_id, q FROM r WHERE k = 0
           UNION SELECT u.doc_id, u.q FROM u JOIN (SELECT j.doc_id, j.a, j.b FROM j JOIN u ON u.doc_id = j.doc_id AND u.q BETWEEN j.a AND j.b GROUP BY ALL HAVING sum(words) >= {_LEAST}) x ON u.doc_id = x.doc_id AND u.q BETWEEN x.a AND x.b),
     y AS (SELECT g.doc_id, g.q, u.a, u.b, g.q - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.q) AS run FROM g JOIN u ON u.doc_id = g.doc_id AND u.q = g.q),
     z AS (SELECT doc_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM y GROUP BY doc_id, run),
     k AS (SELECT doc_id, count(*) AS n_removed, sum(b - a)::BIGINT AS removed_chars, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM z GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars, coalesce(spans, '') AS spans,
       sha256(CASE WHEN n_removed IS NULL THEN t ELSE array_to_string(list_transform(range(1, len(la) + 2), lambda i: t[(CASE WHEN i = 1 THEN 0 ELSE lb[i - 1] END) + 1 : (CASE WHEN i > len(la) THEN length(t) ELSE la[i] END)]), '') END) AS clean_sha256
FROM d LEFT JOIN k USING (doc_id)"""



def _op11() -> str:
    """Integer vectors, their parts, and codebooks b0, b1 ... after each round; a distance and an entry's index share one number."""
    k, parts, scale = vector_codes.ENTRIES, vector_codes.PARTS, vector_codes.SCALE
    nearest = "SELECT r, x.p, min(list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e) AS de FROM x JOIN {b} b ON x.p = b.p GROUP BY r, x.p"
    with_ = [
        f"k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"x AS (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS (SELECT p, r - 1 AS e, x FROM x WHERE r <= {k})",
    ]
    for i in range(vector_codes.ROUNDS):
        with_ += [
            f"a{i} AS ({nearest.format(b=f'b{i}')})",
            f"u{i} AS (SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS x FROM (SELECT p, de % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN x USING (r, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS i) GROUP BY ALL) GROUP BY p, e)",
            f"b{i + 1} AS (SELECT p, e, coalesce(u{i}.x, b{i}.x) AS x FROM b{i} LEFT JOIN u{i} USING (p, e))",
        ]
    last = f"b{vector_codes.ROUNDS}"
    with_ += [
        f"a AS ({nearest.format(b=last)})",
        "c AS (SELECT r, string_agg(printf('%02x', de % 256), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM a GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last})",
    ]
    return f"WITH {', '.join(with_)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"


ORACLES: dict[str, str] = {"op10_line_dedup": _OP10, "op11_vector_codes": _op11()}
