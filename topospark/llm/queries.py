"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topospark.llm import neighbours, packing, pieces, related, tokens, topn, variety
from topospark.session import cut_lineage

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_subset(spark: SparkSession, folder: str) -> DataFrame:
    return variety.varied_subset(_table(spark, folder, "cloud_points"), _table(spark, folder, "clouds"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.close_pairs(_table(spark, folder, "cloud_points"), 24)


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_points(_table(spark, folder, "cloud_points"), 24)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return related.related_pairs(_table(spark, folder, "odometry_sequences"), _table(spark, folder, "frame_pairs"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return related.split_sequences(_table(spark, folder, "odometry_sequences"), _table(spark, folder, "frame_pairs"), SHARES)


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    return related.assign_pairs(_table(spark, folder, "odometry_sequences"), _table(spark, folder, "frame_pairs"), SHARES)


def p4_components(spark: SparkSession, folder: str) -> DataFrame:
    """The components of the splits with their weight; each lies in one split."""
    return related.components(p4_splits(spark, folder))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the true neighbours the forest finds, for every point whose id is divisible by 20 against all points."""
    return neighbours.recall(_table(spark, folder, "cloud_points"), 24)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_lifetimes(_table(spark, folder, "tda_features")).select("seq", "frame", "dim", "chunk_no", "pos_no")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut_lineage(tokens.count_tokens(_table(spark, folder, "documents"), ["doc_id", "source"]))  # count once
    return packing.pack(sizes)


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_long(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_subset, p3_found, p3_nearest, p3_recall, p4_found, p4_splits, p4_rows, p4_components, p5_found, p6_ids, p7_containers, p8_pieces)
}

RELATED_SQL = """
WITH RECURSIVE named AS (
  SELECT seq, trim(seq) AS exact, seq AS raw, parent_seq, drive_id, operator_id FROM odometry_sequences WHERE seq IS NOT NULL
), ids AS (
  SELECT seq, kind, regexp_replace(regexp_replace(regexp_replace(lower(x), '\\s+', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[-_.]+', '', 'g') AS k
  FROM (SELECT seq, 'd' AS kind, drive_id AS x FROM named UNION ALL SELECT seq, 'o', operator_id FROM named) WHERE x IS NOT NULL
), scans AS (
  SELECT DISTINCT seq, 's' AS kind, lower(trim(x)) AS k FROM (SELECT seq, scan_t AS x FROM frame_pairs UNION ALL SELECT seq, scan_t1 FROM frame_pairs)
  WHERE x IS NOT NULL AND seq IS NOT NULL AND length(replace(lower(trim(x)), left(lower(trim(x)), 1), '')) > 0
), keys AS (
  SELECT DISTINCT seq, kind, k FROM (SELECT * FROM ids UNION ALL SELECT * FROM scans)
  WHERE regexp_matches(k, '[a-z0-9]') AND k NOT IN ('', 'na', 'n/a', 'none', 'null', 'nil', 'nan', 'unknown', 'unk', 'tbd', '?', 'undefined', 'missing', 'x')
), known AS (
  SELECT DISTINCT seq FROM named UNION SELECT DISTINCT seq FROM frame_pairs WHERE seq IS NOT NULL
), links AS (
  SELECT a.seq AS a, b.seq AS b FROM keys a JOIN keys b ON a.kind = b.kind AND a.k = b.k AND a.seq <> b.seq
  UNION SELECT n.seq, k.seq FROM named n JOIN known k ON trim(n.parent_seq) = k.seq AND n.seq <> k.seq
  UNION SELECT k.seq, n.seq FROM named n JOIN known k ON trim(n.parent_seq) = k.seq AND n.seq <> k.seq
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
"""

ORACLE_SQL: dict[str, str] = {
    "p5_found": """
WITH chunks AS (
  SELECT seq, frame, chunk_no, h0_lifetimes AS h0, h1_lifetimes AS h1, h2_lifetimes AS h2
  FROM tda_features
  QUALIFY row_number() OVER (PARTITION BY seq, frame, chunk_no ORDER BY received_at DESC NULLS LAST) = 1
), dims AS (
  SELECT seq, frame, chunk_no, 0 AS dim, h0 AS h FROM chunks
  UNION ALL SELECT seq, frame, chunk_no, 1, h1 FROM chunks
  UNION ALL SELECT seq, frame, chunk_no, 2, h2 FROM chunks
), places AS (
  SELECT seq, frame, dim, chunk_no, unnest(h) AS lifetime, unnest(range(len(h))) AS pos_no FROM dims
)
SELECT seq, frame, CAST(dim AS INTEGER) AS dim, chunk_no, CAST(pos_no AS INTEGER) AS pos_no
FROM places
WHERE lifetime >= 0 AND lifetime < 'infinity'::FLOAT
QUALIFY row_number() OVER (PARTITION BY seq, frame, dim ORDER BY lifetime DESC, chunk_no, pos_no) <= 10
""",
    "p3_found": """
WITH pts AS (
  SELECT point_id AS id, min(coords) AS v FROM cloud_points
  WHERE point_id IS NOT NULL AND len(coords) = 24 AND len(list_filter(coords, lambda x: x IS NOT NULL AND isfinite(x))) = 24
  GROUP BY point_id
), near AS (
  SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM pts a JOIN pts b ON a.id <> b.id
), ranked AS (
  SELECT a, b, d FROM near WHERE d <= 1.0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(d * d, 9), b) <= 5
)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM ranked
""",
    "p4_found": RELATED_SQL + """SELECT DISTINCT a AS seq_a, b AS seq_b FROM reach WHERE a < b
""",
    "p4_components": RELATED_SQL + """, every AS (
  SELECT seq, max(n) AS n_pairs FROM (
    SELECT seq, 0 AS n FROM odometry_sequences UNION ALL SELECT seq, count(*) AS n FROM frame_pairs GROUP BY seq) GROUP BY seq
), member AS (
  SELECT e.seq, e.n_pairs, least(e.seq, min(r.b)) AS first_seq FROM every e LEFT JOIN reach r ON r.a = e.seq GROUP BY e.seq, e.n_pairs
)
SELECT first_seq, count(*) AS n_seqs, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, CAST(1 AS BIGINT) AS n_splits FROM member GROUP BY first_seq
""",
}
