"""The queries of this package's operators, over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import docpairs, fragments, handwritten, neighbours, packing, pieces, spam, tokens
from siftwork.runtime import keep, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.neighbours(table(spark, folder, "vectors")))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.neighbours(table(spark, folder, "vectors"), min_cosine=None)
    return found.select("id", "neighbour", F.round("cosine", 5).alias("cosine"), "rank")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return fragments.expand(*fragments.similar_fragments(table(spark, folder, "code_fragments")), "fragment_a", "fragment_b")


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return fragments.class_links(*fragments.similar_fragments(table(spark, folder, "code_fragments")), "fragment_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, folder, "source_files")).select("path").distinct()


def p4_signals(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, folder, "source_files"))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    # the symbol table is read three times: what is said, who asks for it, and the definitions
    return docpairs.documented_functions(keep(docpairs.symbol_table(table(spark, folder, "source_files")), "symbols"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    # the cases are those whose description, of all that the join finds, is their own
    return p5_pairs(spark, folder).where("description_of = 'own'").select("path", "line").distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_items(table(spark, folder, "code_fragments"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_pieces(spark, folder).select("fragment_id").distinct()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, folder, "documents")).select("doc_id").distinct()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_classes, p4_found, p4_signals, p5_found, p5_pairs, p6_found, p6_pieces, p7_ids, p8_containers, p9_found, p9_shares)}

ORACLES: dict[str, str] = {
    "p1_found": """
        WITH latest AS (
            SELECT id, arg_max(struct_pack(e := embedding), updated_at).e AS e FROM vectors WHERE id IS NOT NULL GROUP BY id
        ), entries AS (
            SELECT id, list_transform(e, lambda x: x::DOUBLE) AS e FROM latest
            WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), sims AS (
            SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.e, b.e) AS s FROM entries a JOIN entries b ON a.id <> b.id
        ), near AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS n FROM sims WHERE s >= 0.85
        )
        SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM near WHERE n <= 5
    """,
    "p2_found": """
        WITH words AS (
            SELECT DISTINCT fragment_id AS id, regexp_extract_all(lower(coalesce(function_signature, '') || chr(10) || code_content), '[a-z0-9_]+') AS w
            FROM code_fragments WHERE code_content IS NOT NULL
        ), sets AS (
            SELECT id, row_number() OVER () AS n, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
            FROM words WHERE len(w) >= 3
        ), runs AS (
            SELECT n, unnest(s) AS run FROM sets
        ), common AS (
            SELECT a.n AS x, b.n AS y, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.n < b.n GROUP BY 1, 2
        )
        SELECT DISTINCT least(p.id, q.id) AS fragment_a, greatest(p.id, q.id) AS fragment_b
        FROM common JOIN sets p ON p.n = x JOIN sets q ON q.n = y
        WHERE p.id <> q.id AND c >= 0.6 * (len(p.s) + len(q.s) - c)
    """,
    "p6_found": "SELECT DISTINCT fragment_id FROM code_fragments WHERE length(code_content) > 1600",
}
