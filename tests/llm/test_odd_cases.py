"""Empty tables, nulls in any column, repeated rows and extra columns named like the operators' own."""

from datetime import datetime

from topospark.llm import packing, pieces, related, tokens, topn, variety

T = datetime(2024, 1, 1)
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
SEQUENCES = "seq string, drive_id string, operator_id string, parent_seq string, label string, vertex string, component string"
PAIRS = "seq string, frame_t int, scan_t string, scan_t1 string, split string, n_pairs string, __seq string"
POINTS = "cloud_id bigint, point_id bigint, coords array<double>, intensity double, ingested_at timestamp, units string, level string, rank string, m string"
CLOUDS = "cloud_id bigint, dim int, m int, loaded_at timestamp, cells string"


def test_splits_of_odd_tables(spark):
    sequences = spark.createDataFrame(
        [("a", "D 1", None, None, "x", "x", "x"), ("b", "d-01", None, None, "x", "x", "x"), ("b", "d-01", None, None, "x", "x", "x"), (None, "D1", None, None, None, None, None), ("c", None, None, "a", None, None, None)],
        SEQUENCES,
    )
    rows = [("a", 0, None, None, "old", "x", "x"), ("a", 0, None, None, "old", "x", "x"), ("z", None, None, None, None, None, None), (None, 1, "k", "k", "old", None, None)]
    pairs = spark.createDataFrame(rows, PAIRS)
    assert {tuple(r) for r in related.related_pairs(sequences, pairs).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    placed = related.assign_pairs(sequences, pairs, SHARES)
    assert placed.columns == ["seq", "frame_t", "scan_t", "scan_t1", "n_pairs", "__seq", "split"]
    got = placed.collect()
    assert len(got) == len(rows) and all(r.split in SHARES for r in got)
    assert len({r.split for r in got if r.seq == "a"}) == 1


def test_splits_of_empty_tables(spark):
    sequences, pairs = spark.createDataFrame([], SEQUENCES), spark.createDataFrame([], PAIRS)
    assert related.related_pairs(sequences, pairs).count() == 0
    assert related.split_sequences(sequences, pairs, SHARES).count() == 0
    assert related.assign_pairs(sequences, pairs, SHARES).count() == 0
    lone = spark.createDataFrame([("a",) + (None,) * 6], SEQUENCES)
    assert [(r.seq, r.n_pairs) for r in related.split_sequences(lone, pairs, SHARES).collect()] == [("a", 0)]


def test_varied_subset_of_odd_tables(spark):
    same = [(1, i, [1.0, 1.0, 1.0], None, T, "x", "x", "x", "x") for i in range(7)]
    bad = [(1, 90, None, 1.0, T, "x", "x", "x", "x"), (None, 91, [1.0, 1.0, 1.0], 1.0, None, None, None, None, None), (1, None, [1.0, 1.0, 1.0], 1.0, T, "x", "x", "x", "x"), (2, 92, [1.0, 2.0, float("inf")], 1.0, T, "x", "x", "x", "x"), (3, 93, [1.0, 2.0, 3.0], -1.0, None, "x", "x", "x", "x"), (1, 0, [1.0, 1.0, 1.0], None, None, "x", "x", "x", "x")]
    points = spark.createDataFrame(same + bad, POINTS)
    clouds = spark.createDataFrame([(1, 3, 4, T, "x"), (1, 3, 4, T, "x"), (2, 3, 4, None, "x"), (3, 3, 4, None, None), (4, None, None, None, None), (None, 3, 4, T, "x")], CLOUDS)
    got = variety.varied_subset(points, clouds).collect()
    assert sorted(r.cloud_id for r in got) == [1, 1, 1, 1, 3]
    assert len({(r.cloud_id, r.point_id) for r in got}) == len(got)
    assert variety.varied_subset(points.limit(0), clouds).count() == 0
    assert variety.varied_subset(points, clouds.limit(0)).count() == 0


def test_texts_of_odd_tables(spark):
    long = "One sentence after another. " * 400
    rows = [(1, long, None, "x"), (1, long, "s", "x"), (None, long, "s", "x"), (2, None, None, None), (3, "", "s", "x"), (4, " \n\t ", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens string")
    cut = pieces.split_long(df, 256, 32).toPandas()
    assert cut.doc_id.isna().sum() * 2 == (cut.doc_id == 1).sum() > 0 and set(cut.doc_id.dropna()) == {1}
    assert pieces.split_long(df.limit(0)).count() == 0
    sizes = tokens.count_tokens(df, ["doc_id", "source"])
    placed = packing.pack(sizes, 256).toPandas()
    assert placed.n_tokens.sum() == sizes.groupBy().sum("n_tokens").first()[0]
    assert placed[placed.n_tokens == 0].container_id.isna().all() and placed[placed.n_tokens > 0].container_id.notna().all()
    assert placed.groupby("container_id").n_tokens.sum().max() <= 256
    assert packing.pack(sizes.limit(0), 256).count() == 0


def test_top_items_with_nulls_and_ties(spark):
    schema = "seq string, frame int, chunk_no int, h0_lifetimes array<float>, h1_lifetimes array<float>, h2_lifetimes array<float>, received_at timestamp, __rank string, pos_no string"
    rows = [("a", 1, c, [1.0] * 8, None, [], T, "x", "x") for c in range(3)] * 2
    got = topn.top_lifetimes(spark.createDataFrame(rows, schema)).select("dim", "chunk_no", "pos_no").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, p) for p in range(8)] + [(0, 1, 0), (0, 1, 1)]
    assert topn.top_lifetimes(spark.createDataFrame([], schema)).count() == 0
