"""Changes of columns between result files, and the unified table."""

from datetime import datetime

from topospark.operators import drift

FILES = "file_id bigint, campaign_id bigint, series string, file_format string, written_at timestamp, note string"
LINES = "file_id bigint, line_no int, line string, field string"  # a column whose name the operator also uses


def tables(spark, contents, formats=None, campaigns=None):
    files = [(i, (campaigns or {}).get(i, 1), "s", (formats or {}).get(i, "csv"), datetime(2024, 1, i), "x") for i in contents]
    lines = [(i, n, line, "x") for i, text in contents.items() for n, line in enumerate(text, 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)


def found(spark, contents, **options):
    return {tuple(r) for r in drift.changes(*tables(spark, contents, **options)).collect()}


A = ["seed,mean,b1", "17,0.123456,1.5", "34,0.234567,2.5", "51,0.345678,nan"]


def test_added_removed_renamed_retyped(spark):
    contents = {
        1: A,
        2: ["# a remark", "", "seed;average;b1", "34;2.34567e-01;2.5", "51;3.45678e-01;NA", "68;4.5e-01;3.5", "seed;average;b1"],
        3: ["seed,average,extra", "68,0.45,1", "85,0.55,2"],
        4: ["seed,average,extra", "85.0,v=0.55,2"],
    }
    assert found(spark, contents) == {
        (2, "average", "renamed"), (3, "b1", "removed"), (3, "extra", "added"),
        (4, "seed", "retyped"), (4, "average", "retyped"),
    }


def test_rename_and_retype_at_once_and_type_memory(spark):
    contents = {
        1: A,
        2: ["seed,mean,b1", "51,0.345678,", "68,0.456789,null"],  # all of b1 absent: its type stays
        3: ['"seed","mean","b_1"', '"68","0.456789","~1.5"', '"85","0.567891","~2.5"'],
    }
    assert found(spark, contents) == {(3, "b1", "removed"), (3, "b_1", "added")}  # no value to hold on to
    contents[3] = ["seed,m_e_a_n,b1", "68,~0.45679,", "85,~0.5,7"]
    assert found(spark, contents) == {(3, "m_e_a_n", "renamed"), (3, "m_e_a_n", "retyped"), (3, "b1", "retyped")}


def test_name_that_comes_back_starts_anew(spark):
    contents = {1: A, 2: ["seed,mean", "51,0.345678"], 3: ["seed,mean,b1", "51,0.345678,text"]}
    assert found(spark, contents) == {(2, "b1", "removed"), (3, "b1", "added")}


def test_jsonl_keys_bom_and_quotes(spark):
    contents = {1: A, 2: ['{"seed": 51, "mean": "0.345678"}', '{"seed": 68, "mean": 0.5, "b1": null, "new": 1}']}
    assert found(spark, contents, formats={2: "jsonl"}) == {(2, "new", "added")}
    assert found(spark, {1: A, 2: ["﻿'seed', \"mean\" ,b1", "51,0.345678,"]}) == set()


def test_swapped_candidates_are_matched_by_values(spark):
    one = ["seed,p,q,mean"] + [f"{i},{i * 0.37:.6f},{i * 1.91:.6f},{i * 0.011:.6f}" for i in range(1, 7)]
    two = ["seed,q_new,p_new,mean"] + [f"{i},{i * 0.37:.6f},{i * 1.91:.6f},{i * 0.011:.6f}" for i in range(3, 9)]
    assert found(spark, {1: one, 2: two}) == {(2, "q_new", "renamed"), (2, "p_new", "renamed")}


def test_long_chain_of_renames_keeps_the_type(spark):
    contents = {1: ["seed,mean,a0", "17,0.12,3", "34,0.23,4"]}
    for i in range(1, 6):
        contents[i + 1] = [f"seed,mean,a{i}", "17,0.12,3", "34,0.23,4"]
    contents[7] = ["seed,mean,a5", "17,0.12,3", "34,0.23,4.5"]
    assert found(spark, contents) == {(i + 1, f"a{i}", "renamed") for i in range(1, 6)} | {(7, "a5", "retyped")}


def test_empty_tables_and_null_lines(spark):
    files, lines = tables(spark, {1: A, 2: A})
    assert drift.changes(files.limit(0), lines).count() == 0
    assert drift.changes(files, lines.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, 9, None, None), (None, 1, "x", None), (2, None, None, None)], LINES)
    assert drift.changes(files, lines.unionByName(nulls)).count() == 0


def test_unified_table(spark):
    contents = {1: A, 2: ["seed,average,b1,note", "51,0.345678,2..4,hi", "68,0.4 mm,,"]}
    loaded = {"t": spark.createDataFrame([(1, datetime(2024, 1, 1), 3.0, float("nan"), "1.5")], "run_id bigint, run_at timestamp, seed double, mean double, b1 string")}
    rows = drift.unify(*tables(spark, contents), loaded).collect()
    assert len(rows) == 6
    by = {(r.file_id, r.line_no): r for r in rows}
    assert by[2, 2]["mean"] == 0.345678 and by[2, 2].b1 == 3.0 and by[2, 2].other == {"note": "hi"}
    assert by[2, 3]["mean"] == 0.4 and by[2, 3].b1 is None
    assert by[None, None]["mean"] is None and by[None, None].b1 == 1.5 and by[None, None].origin == "t"


def test_columns_named_like_the_operator_s_own(spark):
    files, lines = tables(spark, {1: A, 2: ["seed,average,b1", *A[2:]]})
    own = ["before", "place", "first_no", "header", "state", "was", "run", "known", "token", "type"]
    for name in own:
        files = files.selectExpr("*", f"'x' as {name}")
        lines = lines.selectExpr("*", f"cast(null as string) as {name}")
    files = files.union(files.where("file_id = 2"))  # a file's row repeated
    assert {tuple(r) for r in drift.changes(files, lines).collect()} == {(2, "average", "renamed")}


def test_decorated_numbers_of_loaded_tables_and_unreadable_values(spark):
    contents = {1: ["seed,mean,b1", "17,87.903%,1.5", "34,0.5,broken", "51,0.6,1.2 of 3.4 or 5", "68,0.7,0.25..0.75"]}
    row = [(1, datetime(2024, 1, 1), 3.0, "25%", "~1.765"), (2, datetime(2024, 1, 1), 4.0, "nan", "broken"), (3, datetime(2024, 1, 1), 5.0, None, "2..4")]
    loaded = {"t": spark.createDataFrame(row, "run_id bigint, run_at timestamp, seed double, mean string, b1 string")}
    rows = drift.unify(*tables(spark, contents), loaded).collect()
    by = {(r.file_id, r.line_no, r.run_id): (r["mean"], r.b1, r.other or {}) for r in rows}
    assert by == {
        (1, 2, None): (0.87903, 1.5, {}), (1, 3, None): (0.5, None, {"b1": "broken"}), (1, 4, None): (0.6, None, {"b1": "1.2 of 3.4 or 5"}),
        (1, 5, None): (0.7, 0.5, {}),
        (None, None, 1): (0.25, 1.765, {}), (None, None, 2): (None, None, {"b1": "broken"}), (None, None, 3): (None, 3.0, {}),
    }
