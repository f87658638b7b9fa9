"""Containers and pieces: exact rules on small and hostile inputs."""

import numpy as np
import pandas as pd
import pytest

from topospark.llm import packing, pieces, tokens


def pack(spark, rows, capacity=100, **options):
    return packing.pack(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, piece_no string"), capacity, **options).toPandas()


def test_every_token_is_placed_once_and_only_giants_are_divided(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "b", None][i % 3] if i % 5 else "hot", int(n), "x") for i, n in enumerate(rng.integers(1, 100, 300))]
    rows += [(1000, "a", 950, "x"), (1001, "b", 100, "x"), (1002, None, 0, "x"), (1003, "c", None, "x"), (5, "a", 7, "x")]
    for shard in (1 << 22, 2000):
        out = pack(spark, rows, shard_tokens=shard)
        placed = out[out.container_id.notna()]
        assert placed.groupby("container_id").n_tokens.sum().max() <= 100
        assert placed.n_tokens.sum() == sum(r[2] or 0 for r in rows)
        assert (placed.groupby("doc_id").piece_no.max() > 0).sum() == 1
        for _, own in placed.sort_values("offset").groupby("container_id"):
            assert (own.offset.to_numpy() == np.cumsum(own.n_tokens) - own.n_tokens).all()
        giant = placed[placed.doc_id == 1000].sort_values("piece_no")
        assert giant.n_tokens.tolist() == [100] * 9 + [50] and giant.token_start.tolist() == list(range(0, 1000, 100))
        assert out.container_id.isna().sum() == 2 and len(placed[placed.doc_id == 5]) == 2


def test_little_is_left_empty():
    rng = np.random.default_rng(2)
    sizes = np.minimum(2047, rng.lognormal(6.2, 0.9, 3000)).astype(int) + 1
    items = pd.DataFrame({"source": rng.choice(list("abcdef"), 3000), "size": sizes, "key": range(3000), "piece_no": 0, "carried": 0.0})
    items["share"] = items.groupby("source")["size"].transform("sum") / sizes.sum()
    out = packing.fill(items, 2048)
    assert sizes.sum() / 2048 / (out.container_no.max() + 1) > 0.98


def test_mixture_holds_along_the_way():
    rng = np.random.default_rng(3)
    items = pd.DataFrame({"source": rng.choice(["a", "b"], 4000, p=[0.75, 0.25]), "size": rng.integers(10, 200, 4000), "key": range(4000), "piece_no": 0, "carried": 0.0})
    items["share"] = items.groupby("source")["size"].transform("sum") / items["size"].sum()
    items["container"] = packing.fill(items, 2048).container_no
    half = items[items.container <= items.container.max() // 2]
    share = half[half.source == "a"]["size"].sum() / half["size"].sum()
    assert abs(share - items[items.source == "a"].share.iloc[0]) < 0.02


def test_given_shares_hold_over_shards_while_there_are_items(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "abc"[i % 3], int(n), "x") for i, n in enumerate(rng.integers(10, 60, 3000))]
    out = pack(spark, rows, shares={"a": 0.5, "b": 0.25, "c": 0.25}, shard_tokens=4000)
    assert len(out) == 3000 and out.container_id.notna().all()
    shard = out.container_id.astype("int64") // (1 << 32)
    # up to the shard where a is used up; each shard's own items bound what it can give
    early = out[shard < shard.max() // 3]
    share = early.groupby("source").n_tokens.sum() / early.n_tokens.sum()
    assert share["a"] < 0.5  # shards hold a third of each, all of which is placed
    first = out[shard == 0].sort_values(["container_id", "offset"])
    lead = first[first.container_id.isin(sorted(first.container_id.unique())[:12])]
    assert abs((lead[lead.source == "a"].n_tokens.sum() / lead.n_tokens.sum()) - 0.5) < 0.06


def test_sums_before_come_by_buckets(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(2000)], "shard bigint, source string, given bigint")
    got = packing.sums_before(rows, ["source"], "shard", "given", "before").toPandas()
    for source in "ab":
        own = got[got.source == source].sort_values("shard")
        assert (own.before.to_numpy() == np.cumsum(own.given) - own.given).all() and len(own) == 1000


def test_no_rows_give_no_containers(spark):
    assert len(pack(spark, [])) == 0
    assert pack(spark, [(1, "a", 0, "x")]).container_id.isna().all()


TEXT = "TITLE\n\n" + "\n\n".join(
    f"Part {p}\n\n" + "\n\n".join(f"{n} The court heard the parties at length. It then turned to the claim of Mr. P. Kin. No more was said." for n in range(p * 9, p * 9 + 9))
    for p in range(8)
)


@pytest.mark.parametrize("text", [TEXT, TEXT.replace("\n", "\r\n"), "word " * 3000, "x1é" * 2000, " \n" * 4000 + "end", "日本語" * 900])
def test_pieces_cover_overlap_and_fit(spark, text):
    rows = spark.createDataFrame([(1, text, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x")], "doc_id bigint, text string, piece_no string")
    limit, overlap = 128, 16
    out = pieces.split_long(rows, limit, overlap).toPandas().sort_values("piece_no")
    ids = tokens.encode(rows.where("doc_id = 1")).first().ids
    assert set(out.doc_id) == {1} and out.piece_no.tolist() == list(range(len(out)))
    assert out.n_tokens.max() <= limit and out.token_start.iloc[0] == 0 and out.token_end.iloc[-1] == len(ids)
    assert (out.token_start.iloc[1:].to_numpy() == out.token_end.iloc[:-1].to_numpy() - overlap).all()
    assert all(t and t in text for t in out.text)
    assert text.startswith(out.text.iloc[0]) and text.endswith(out.text.iloc[-1])


def test_pieces_end_where_the_text_does(spark):
    rows = spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string")
    out = pieces.split_long(rows, 256, 32).toPandas()
    assert set(out.ends_at) <= {"part", "paragraph", "end"}
    assert pieces.split_long(rows, 100_000, 64).count() == 0 and pieces.split_long(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_long(rows, 64, 64)


def test_breaks_know_headings_numbers_sentences_and_wrapped_lines():
    wrapped = "Tatbestand\n\n(1) Erster Satz hier, der recht lang ist und deshalb umbrochen wird bei\n46 710 Taler. Zweiter Satz mit Dr. Kin. Dritter.\n- Punkt eins"
    kinds = {wrapped[c:].lstrip().split()[0]: k // pieces.DEPTHS for c, k in pieces.breaks(wrapped)}
    assert kinds["(1)"] == pieces.PARAGRAPH and kinds["46"] == pieces.LINE and kinds["Zweiter"] == pieces.SENTENCE and kinds["-"] == pieces.PARAGRAPH
    assert "Kin." not in kinds


def test_breaks_nest_headings_and_numbering():
    lines = ["# A", "## B", "1. one", "1.1 first", "(a) x", "(b) y", "1.2 second", "2. two", "- p", "  - q", "- r", "Rn. 5 text", "Costs", "¶ 1 More", "Page 3 of 9", "1.2.1 deep", "1.3 less"]
    text = "\n".join(lines)
    found = {text[c:].split("\n")[0].strip(): divmod(k, pieces.DEPTHS) for c, k in pieces.breaks(text)}
    part, para = pieces.PART, pieces.PARAGRAPH
    assert found["## B"] == (part, 1) and found["1. one"] == (para, 0) and found["1.1 first"] == (para, 1)
    assert found["(a) x"] == found["(b) y"] == (para, 2) and found["1.2 second"] == (para, 1) and found["2. two"] == (para, 0)
    assert found["- p"] == found["- r"] and found["- q"][1] == found["- p"][1] + 1
    assert found["Rn. 5 text"][0] == para and found["Costs"] == (part, 0) and found["¶ 1 More"] == (para, 0)
    assert found["Page 3 of 9"][0] == pieces.LINE and found["1.3 less"][1] == found["1.2.1 deep"][1]


def test_parts_that_fit_are_not_cut_and_siblings_merge():
    # two parts of 30 tokens, one of 130 with paragraphs of 20, one of 30; limit 64
    at = np.array([30, 60, 80, 100, 120, 140, 160, 190])
    kinds = np.array([0, 0, 1, 1, 1, 1, 1, 0]) * pieces.DEPTHS
    assert pieces.pack_tree(at, kinds, np.arange(221), 220, 64) == [60, 120, 160, 190, 220]
