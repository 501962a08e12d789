"""Queries of the package's operators, as the driver calls them: (spark, data directory) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import bpe, neighbours, packing, residue, similar, splitting
from veldra.runtime import materialize, read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(spark, read_table(spark, d, "chunks"), words=3, t=0.6)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class and the number of its similar records: whole for classes of any size."""
    return similar.similar_links(spark, read_table(spark, d, "chunks"), words=3, t=0.6)


def p2_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_classes(spark, read_table(spark, d, "chunks"), words=3, t=0.6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_pairs(spark, read_table(spark, d, "vector_store").select("row_id", "embedding"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_forward(read_table(spark, d, "chunks"))


def p4_bisect(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_bisect(read_table(spark, d, "chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(spark, read_table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(spark, read_table(spark, d, "documents"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p7_containers: no load over the capacity, each text whole and once, only longer ones cut, few containers."""
    docs = read_table(spark, d, "documents")
    sizes = materialize(bpe.token_counts(spark, docs), "sizes")
    rows = materialize(packing.pack_sizes(sizes), "packed")
    n = F.col("token_end") - F.col("token_start")
    loads = rows.groupBy("container_id").agg(F.sum(n).alias("load")).agg(F.count("*").alias("containers"), F.max("load").alias("most"), F.sum("load").alias("tokens"))
    texts = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(n).alias("tokens"), F.min("token_start").alias("first"), F.max("token_end").alias("last"))
    good = (F.col("tokens") == F.coalesce("n_tokens", F.lit(0))) & (F.col("first") == 0) & (F.col("last") == F.col("tokens")) & (F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1)))
    checked = texts.join(sizes, "doc_id").agg(F.count("*").alias("documents"), F.bool_and(good).alias("whole"))
    found = loads.first()
    few = found["containers"] <= 1.01 * -(-(found["tokens"] or 0) // packing.CAPACITY) + 1
    return checked.select("documents", "whole", F.lit((found["most"] or 0) <= packing.CAPACITY).alias("within"), F.lit(few).alias("few"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(read_table(spark, d, "documents"))


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates that p8_found classifies, with the number of their lines."""
    return residue.templates(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p2_class_pairs, p3_found, p4_found, p4_bisect, p6_ids, p7_containers, p7_totals, p8_found, p8_templates)}
_LF, _CR = "chr(10)", "chr(13)"
_ENDS = "list_filter(range(1, len(text) + 1), lambda e: {})"
_CUTS = f"""t AS (SELECT row_id, len(text) AS n,
            {_ENDS.format(f"substring(text, e - 1, 2) = {_LF} || {_LF} AND e > 1 OR substring(text, e - 2, 3) = {_LF} || {_CR} || {_LF} AND e > 2")} AS blank,
            {_ENDS.format(f"substring(text, e, 1) = {_LF}")} AS feed,
            {_ENDS.format("e > 1 AND substring(text, e - 1, 1) IN ('.', '!', '?') AND substring(text, e, 1) IN (' ', chr(9)) OR substring(text, e, 1) IN ('。', '！', '？')")} AS stop,
            {_ENDS.format("substring(text, e, 1) IN (' ', chr(9))")} AS gap
            FROM chunks WHERE len(text) > 512)"""
_NEAR = "list_sort(list_transform(list_filter({}, lambda x: abs(x - (a + b) // 2) <= (b - a) // 4), lambda x: [abs(x - (a + b) // 2), x]))[1][2]"
_IN = "list_max(list_filter({}, lambda x: x BETWEEN s + 257 AND s + 512))"

_SIMILAR = """
        WITH w AS (SELECT row_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        s AS (SELECT DISTINCT row_id, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
        n AS (SELECT row_id, count(*) AS n FROM s GROUP BY row_id),
        c AS (SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.row_id < b.row_id{} GROUP BY 1, 2),
        p AS (SELECT row_a, row_b FROM c JOIN n x ON x.row_id = row_a JOIN n y ON y.row_id = row_b WHERE k * 10 >= 6 * (x.n + y.n - k)),
        k AS (SELECT row_id, min(row_id) OVER (PARTITION BY l) AS class_id FROM (SELECT row_id, list(g ORDER BY g) AS l FROM s GROUP BY row_id))"""
_APART = _SIMILAR.format(" AND a.doc_id <> b.doc_id")

ORACLES: dict[str, str] = {
    "p2_found": f"{_APART} SELECT row_a, row_b FROM p",
    "p2_classes": f"{_APART}, e AS (SELECT row_a AS row_id FROM p UNION ALL SELECT row_b FROM p), l AS (SELECT row_id, count(*) AS links FROM e GROUP BY row_id) SELECT row_id, class_id, coalesce(links, 0) AS links FROM k LEFT JOIN l USING (row_id)",
    "p2_class_pairs": f"{_SIMILAR.format('')} SELECT DISTINCT least(x.class_id, y.class_id) AS class_a, greatest(x.class_id, y.class_id) AS class_b FROM p JOIN k x ON x.row_id = row_a JOIN k y ON y.row_id = row_b WHERE x.class_id <> y.class_id",
    "p7_totals": "SELECT count(*) AS documents, true AS whole, true AS within, true AS few FROM documents",
    "p4_bisect": f"""
        WITH RECURSIVE {_CUTS},
        g AS (SELECT row_id, 0::BIGINT AS a, n AS b, 512 AS most FROM t
            UNION ALL SELECT row_id, unnest([a, c]) AS a, unnest([c, b]) AS b, 462 AS most FROM (SELECT g.*, coalesce({_NEAR.format("blank")}, {_NEAR.format("feed")}, {_NEAR.format("stop")}, {_NEAR.format("gap")}, (a + b) // 2) AS c FROM g JOIN t USING (row_id) WHERE b - a > most)),
        p AS (SELECT row_id, a, b FROM g WHERE b - a <= most UNION ALL SELECT row_id, 0, len(text) FROM chunks WHERE len(text) BETWEEN 1 AND 512)
        SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY a) - 1)::INTEGER AS piece_no, CASE WHEN a = 0 THEN 0 ELSE greatest(a - 50, 0) END::INTEGER AS char_start, b::INTEGER AS char_end FROM p""",
    "p4_found": f"""
        WITH RECURSIVE {_CUTS},
        p AS (SELECT row_id, 0 AS piece_no, 0::BIGINT AS s, CASE WHEN n <= 512 THEN n ELSE coalesce({_IN.format("blank")}, {_IN.format("feed")}, {_IN.format("stop")}, {_IN.format("gap")}, s + 512) END AS e FROM (SELECT *, 0::BIGINT AS s FROM t)
            UNION ALL SELECT row_id, piece_no, s, CASE WHEN n - s <= 512 THEN n ELSE coalesce({_IN.format("blank")}, {_IN.format("feed")}, {_IN.format("stop")}, {_IN.format("gap")}, s + 512) END FROM (SELECT t.*, p.piece_no + 1 AS piece_no, p.e - 50 AS s FROM p JOIN t USING (row_id) WHERE p.e < t.n))
        SELECT row_id, piece_no, s::INTEGER AS char_start, e::INTEGER AS char_end FROM p""",
}
