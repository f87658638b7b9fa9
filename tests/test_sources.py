"""Round trips through files."""

import struct

import numpy as np
import pytest

from topospark.operators import prepare
from topospark.sources import generators, readers, sinks


def test_velodyne(spark, tmp_path):
    folder = tmp_path / "07" / "velodyne"
    folder.mkdir(parents=True)
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (folder / "000005.bin").write_bytes(x.tobytes())
    rows = readers.read_velodyne(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [r.coords for r in rows] == x[:, :3].tolist() and {(r.seq, r.frame) for r in rows} == {("07", 5)}
    with pytest.raises(readers.FormatError):
        readers.decode_velodyne(b"12345")


def test_npy_and_csv(spark, tmp_path):
    x = np.random.default_rng(1).random((5, 3))
    np.save(tmp_path / "a.npy", x)
    rows = readers.read_cloud(spark, str(tmp_path / "a.npy")).orderBy("point_id").collect()
    assert np.allclose([r.coords for r in rows], x)
    (tmp_path / "b.csv").write_text("\n".join(",".join(map(repr, map(float, r))) for r in x))
    rows = readers.read_cloud(spark, str(tmp_path / "b.csv")).orderBy("point_id").collect()
    assert np.allclose([r.coords for r in rows], x)
    assert readers.infer_format("x/brain.nii.gz") == "nifti"
    with pytest.raises(ValueError):
        readers.infer_format("x.zip")


def test_ply_round_trip_and_errors(spark, tmp_path):
    pts = generators.builtin(spark, "sphere", 7, 1)
    sinks.write_ply(pts, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    rows = readers.read_ply(spark, str(tmp_path / "out")).collect()
    assert len(rows) == 7 and sorted(np.round([r.coords[0] for r in rows], 5)) == sorted(np.round([r.coords[0] for r in pts.collect()], 5))
    for bad in (b"", b"ply\nformat binary 1.0\nend_header\n", b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"):
        with pytest.raises(readers.FormatError):
            readers.decode_ply(bad)


def test_nifti(spark, tmp_path):
    data = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<3f", head, 108, 352.0, 2.0, 1.0)
    struct.pack_into("<h", head, 254, 1)
    struct.pack_into("<12f", head, 280, 2, 0, 0, 5, 0, 2, 0, 6, 0, 0, 2, 7)
    head[344:348] = b"n+1\0"
    (tmp_path / "v.nii").write_bytes(bytes(head) + data.tobytes(order="F"))
    rows = readers.read_volumes(spark, str(tmp_path)).collect()
    assert {(r.i, r.j, r.k): r.value for r in rows}[1, 2, 3] == 2 * data[1, 2, 3] + 1
    assert rows[0].affine[3] == 5.0


def test_poses_skip_other_lines(spark, tmp_path):
    (tmp_path / "03.txt").write_text(" ".join(map(str, range(12))) + "\nnot a pose\n" + " ".join(["1"] * 12) + "\n")
    rows = readers.read_poses(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.seq, r.frame) for r in rows] == [("03", 0), ("03", 1)] and rows[0].pose[11:] == [11.0, 0.0, 0.0, 0.0, 1.0]


def test_results_and_cases(spark, tmp_path):
    runs = {"a": spark.createDataFrame([("x", 1.0)], "dataset string, m double"), "b": spark.createDataFrame([("y", 2.0)], "dataset string, seed double")}
    sinks.write_results(sinks.combine(runs), str(tmp_path / "r"))
    back = readers.read_results(spark, str(tmp_path / "r"))
    assert back.columns == ["batch_label", "dataset", "m", "seed"] and back.count() == 2
    (tmp_path / "cases.json").write_text('[{"builtin": "torus", "m": 4}]')
    assert readers.read_cases(spark, str(tmp_path / "cases.json")).first().m == 4
    frame = spark.createDataFrame([(" a, ,b ",)], "t string")
    assert frame.select(readers.parse_methods(frame.t)).first()[0] == ["a", "b"]


def test_csv_lines_are_numbered_by_file_however_it_is_cut(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{i},{ord(name)},0\n" for i in range(400)))
    seen = []
    for size in ("64m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.read_csv(spark, str(tmp_path), 3).collect()
        seen.append({(r.path[-5:], r.point_id, r.coords[0]) for r in rows})
        assert len(rows) == 800 and all(r.point_id == r.coords[0] for r in rows)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]


def test_volumes_take_their_own_affine(spark):
    rows = [("v", 5, 1, 2, 3, 0.5, [2.0, 0, 0, 1, 0, 3, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1.0])]
    voxels = spark.createDataFrame([(*r[:-1], [float(x) for x in r[-1]]) for r in rows], "cloud_id string, voxel_id bigint, i int, j int, k int, value double, affine array<double>")
    assert prepare.voxels_to_world(voxels).first().coords == [3.0, 6.0, 3.0]


def test_command_line_runs_volumes_and_cases(spark, tmp_path):
    from topospark import cli

    cli.main(["volume", "--synthetic", "--preset", "fast", "--methods", "random", "--m", "12", "--max-points", "300", "--output", str(tmp_path / "v"), "--dataset-label", "brain"])
    rows = readers.read_results(spark, str(tmp_path / "v")).collect()
    assert [(r.dataset, r.method, r.m) for r in rows] == [("brain", "random", 12.0)]
    (tmp_path / "cases.json").write_text('[{"builtin": "torus", "samples": 120, "m": 10, "methods": "random, grid"}, {"builtin": "moons", "samples": 100, "m": 8, "dataset_label": "own"}]')
    cli.main(["cases", "--input", str(tmp_path / "cases.json"), "--output", str(tmp_path / "c")])
    rows = readers.read_results(spark, str(tmp_path / "c")).collect()
    assert sorted((r.batch_label, r.method) for r in rows) == [("pointcloud_case_1.csv", "grid"), ("pointcloud_case_1.csv", "random"), ("pointcloud_case_2.csv", "hybrid")]
    assert all(r.coverage_ratio > 0.9 for r in rows) and {r.dataset for r in rows if r.m == 8} == {"own"}
    with pytest.raises(SystemExit):
        cli.main(["landmarks", "--builtin", "torus", "--m", "0", "--output", str(tmp_path / "x")])
