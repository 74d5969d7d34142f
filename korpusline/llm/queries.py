"""The registered queries of the problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusline.functions.session import table
from korpusline.llm import corpus_encoding, garbled_texts, leaked_passages, near_duplicates, scanned_pages, similar_vectors, split_oversized, truncated_texts

#: TESTDATA.md states three words and 0.7 for problem 3.
CHUNK_PAIRS = near_duplicates.NearConfig(shingle=3, threshold=0.7)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized.text_items(table(spark, d, "elements"), table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized.oversized(_items(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized.split_oversized(_items(spark, d)).dropDuplicates(["item_kind", "item_id", "piece_no"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts.garbled_texts(table(spark, d, "elements")).select("id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts.restored_texts(table(spark, d, "elements"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, d, "chunks"), CHUNK_PAIRS)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "chunks"), CHUNK_PAIRS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.neighbour_pairs(similar_vectors.fields_of(table(spark, d, "doc_fields_npz")))


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = similar_vectors.fields_of(table(spark, d, "doc_fields_npz"))
    return similar_vectors.knn_scan(vectors.filter(F.pmod("key", F.lit(20)) == 0), vectors)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned_pages.noisy_pages(table(spark, d, "elements")).select("id")


def p5_traces(spark: SparkSession, d: str) -> DataFrame:
    return scanned_pages.noisy_pages(table(spark, d, "elements"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanned_pages.repaired_paragraphs(table(spark, d, "elements"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_encoding.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages.similar_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts.truncated_texts(table(spark, d, "documents")).select("doc_id")


def p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts.truncated_texts(table(spark, d, "documents"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts.truncation_by_source(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_pieces, p2_found, p2_restored, p3_found, p3_groups, p4_found, p4_knn, p5_found, p5_traces, p5_paragraphs, p6_ids, p7_found, p7_leaks, p8_found, p8_reasons, p8_sources)
    return {f.__name__: f for f in own}


#: The words of a text as TESTDATA.md has them.
WORDS = "regexp_extract_all(replace(lower({x}), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+', 0)"


def _runs(table: str, key: str, size: int) -> str:
    """Distinct (key, run) of successive words."""
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {size - 1}], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {size - 2})) AS i FROM (SELECT {key}, {WORDS.format(x='text')} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= {size})"


def _cosines(field: str) -> str:
    """The pairs of rows with the cosine that p4_found asks for, compared one by one."""
    return f"""SELECT DISTINCT '{field}' AS field, least(a, b) AS row_a, greatest(a, b) AS row_b FROM (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM (
        SELECT x.row_no AS a, y.row_no AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM v x, v y WHERE x.row_no <> y.row_no)) WHERE k <= 5 AND cosine >= 0.9"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that plain SQL computes on whole tables in reasonable time."""
    vectors = "v AS MATERIALIZED (SELECT DISTINCT row_no, {f}_vec::DOUBLE[] AS v FROM doc_fields_npz WHERE {f}_vec IS NOT NULL AND list_sum(list_transform({f}_vec, lambda x: abs(x))) > 0)"
    return {
        "p1_found": """
            SELECT DISTINCT 'chunk' AS item_kind, id AS item_id FROM chunks WHERE greatest(1, length(text) // 4) > 512
            UNION ALL
            SELECT DISTINCT 'element', id FROM elements WHERE greatest(1, length(text) // 4) > 512""",
        "p3_found": f"""
            WITH runs AS MATERIALIZED ({_runs('chunks', 'id', 3)}), size AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
            common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM runs a JOIN runs b USING (run) WHERE a.id < b.id GROUP BY ALL)
            SELECT id_a, id_b FROM common c JOIN size a ON a.id = id_a JOIN size b ON b.id = id_b WHERE c.n >= 0.7::DOUBLE * (a.n + b.n - c.n)""",
        "p4_found": f"SELECT * FROM (WITH {vectors.format(f='heading')} {_cosines('heading')}) UNION ALL SELECT * FROM (WITH {vectors.format(f='path')} {_cosines('path')})",
        "p7_found": f"""
            WITH i AS MATERIALIZED ({_runs('eval_items', 'item_id', 13)}), d AS ({_runs('documents', 'doc_id', 13)})
            SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)""",
    }
