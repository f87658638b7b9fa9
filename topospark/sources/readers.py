"""Readers of point clouds, volumes, poses and result files.

Binary files come through Spark's ``binaryFile`` source, one row a file, and are decoded in Arrow
batches; a file is the unit of work, a folder of files is spread over the cluster. Text formats
are read and parsed by Spark.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 65536
POINTS = "path string, point_id bigint, coords array<double>, intensity double"
VOXELS = "path string, voxel_id bigint, i int, j int, k int, value double, affine array<double>"


class FormatError(ValueError):
    """A file does not hold what its format promises."""


def _files(spark: SparkSession, path: str, pattern: str | None = None, limit: int = 0) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.orderBy("path").limit(limit) if limit else files


def _decode(files: DataFrame, decode: Callable[[bytes], tuple[np.ndarray, np.ndarray]], schema: str = POINTS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    xyz, intensity = decode(content.as_py())
                except FormatError as error:
                    raise FormatError(f"{path}: {error}") from None
                for low in range(0, len(xyz), ROWS):
                    part = np.ascontiguousarray(xyz[low : low + ROWS], dtype=np.float64)
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * len(part)), pa.array(np.arange(low, low + len(part))),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel())),
                            pa.array(np.asarray(intensity[low : low + ROWS], dtype=np.float64)),
                        ],
                        ["path", "point_id", "coords", "intensity"],
                    )

    return files.select("path", "content").mapInArrow(run, schema)


def decode_velodyne(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian records of x, y, z, reflectance as 32-bit floats."""
    if len(content) % 16:
        raise FormatError("length is no multiple of four 32-bit floats")
    records = np.frombuffer(content, dtype="<f4").reshape(-1, 4)
    return records[:, :3], records[:, 3]


def decode_npy(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A two-dimensional array of numbers; unit intensities."""
    try:
        array = np.load(io.BytesIO(content), allow_pickle=False)
    except ValueError as error:
        raise FormatError(str(error)) from None
    if array.ndim != 2:
        raise FormatError("the array is not two-dimensional")
    return array.astype(np.float64), np.ones(len(array))


def decode_ply(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of an ASCII PLY file."""
    head, mark, body = content.partition(b"end_header")
    lines = [line.strip() for line in head.decode("ascii", "replace").splitlines() if line.strip()]
    if not mark or not lines or lines[0] != "ply":
        raise FormatError("no PLY header")
    if not any(re.fullmatch(r"format\s+ascii\s+1\.0", line) for line in lines):
        raise FormatError("only ASCII PLY is read")
    element, count, skip, names = "", 0, 0, []
    for line in lines:
        words = line.split()
        if words[0] == "element":
            if element != "vertex" and not names and words[1] != "vertex":
                skip += int(words[2])
            element = words[1]
            if element == "vertex":
                count = int(words[2])
        elif words[0] == "property" and element == "vertex":
            names.append(words[-1])
    if not {"x", "y", "z"} <= set(names):
        raise FormatError("no vertices with x, y and z")
    rows = [row.split() for row in body.decode("ascii", "replace").splitlines()[1:] if row.strip()][skip : skip + count]
    if len(rows) < count:
        raise FormatError(f"{count} vertices promised, {len(rows)} found")
    at = [names.index(axis) for axis in "xyz"]
    try:
        xyz = np.array([[float(row[i]) for i in at] for row in rows], dtype=np.float64).reshape(-1, 3)
    except (ValueError, IndexError):
        raise FormatError("a vertex does not hold numbers") from None
    return xyz, np.ones(len(xyz))


# Data type codes of the public NIfTI-1 header.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def decode_nifti(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A volume and its affine out of a NIfTI-1 file, gzipped or not."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if len(raw) < 352:
        raise FormatError("shorter than a header")
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    if struct.unpack_from(order + "i", raw)[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise FormatError("no NIfTI-1 header")
    dims = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in NIFTI_TYPES:
        raise FormatError(f"data type {code} is not read")
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    shape = [max(1, d) for d in dims[1 : 1 + max(3, dims[0])]]
    data = np.frombuffer(raw, dtype=order + NIFTI_TYPES[code], count=int(np.prod(shape)), offset=int(offset)).reshape(shape, order="F")
    volume = data.reshape(*shape[:3], -1, order="F")[..., 0].astype(np.float64)
    if slope not in (0.0,) and np.isfinite(slope):
        volume = volume * slope + inter
    affine = np.eye(4)
    if struct.unpack_from(order + "h", raw, 254)[0] > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    else:
        affine[[0, 1, 2], [0, 1, 2]] = struct.unpack_from(order + "8f", raw, 76)[1:4]
    return volume, affine


def read_volumes(spark: SparkSession, path: str, pattern: str = "*.nii*", limit: int = 0) -> DataFrame:
    """Voxels of all volumes of a folder with their affine (row-major, 16 numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in VOXELS.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                volume, affine = decode_nifti(content.as_py())
                flat, n = volume.ravel(), volume.size
                for low in range(0, n, ROWS):
                    ids = np.arange(low, min(n, low + ROWS))
                    i, j, k = (x.astype(np.int32) for x in np.unravel_index(ids, volume.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), pa.array(i), pa.array(j), pa.array(k), pa.array(flat[ids]), pa.array([affine.ravel().tolist()] * len(ids))], names)

    return _files(spark, path, pattern, limit).select("path", "content").mapInArrow(run, VOXELS)


def read_velodyne(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Points of LiDAR frames ``.../<seq>/.../<frame>.bin``: (seq, frame, point_id, coords, intensity)."""
    points = _decode(_files(spark, path, "*.bin", limit), decode_velodyne)
    frame = F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("int")
    seq = F.regexp_extract("path", r"([^/]+)/(?:velodyne/)?[0-9]+\.bin$", 1)
    return points.select(seq.alias("seq"), frame.alias("frame"), "point_id", "coords", "intensity")


def read_npy(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Points of two-dimensional arrays, one cloud a file."""
    return _decode(_files(spark, path, "*.npy", limit), decode_npy)


def read_ply(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Vertices of ASCII PLY files, one cloud a file; also of folders that ``write_ply`` wrote."""
    return _decode(_files(spark, path, "*.{ply,txt}", limit), decode_ply)


def ply_of_archive(content: bytes, member: str) -> bytes:
    """A member of a tar archive, gzipped or not."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
        for entry in archive:
            if entry.isfile() and entry.name.endswith(member):
                return archive.extractfile(entry).read()
    raise FormatError(f"no member {member}")


def read_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Points of comma-separated files without header, ``columns`` numbers a line; a line of other length or content is null there."""
    schema = ", ".join(f"c{i} double" for i in range(columns))
    rows = spark.read.option("recursiveFileLookup", "true").csv(path, schema=schema)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.array(*[f"c{i}" for i in range(columns)]).alias("coords"))
    # lines are numbered by file, from counts of the blocks before and the place in the block, however the blocks are cut
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    numbered = rows.withColumn("point_id", within).join(blocks, ["path", "block"])
    return numbered.select("path", (F.col("before") + F.col("point_id")).alias("point_id"), "coords", F.lit(1.0).alias("intensity"))


def infer_format(path: str) -> str:
    """The format of a cloud file by its ending."""
    endings = {"npy": "npy", "csv": "csv", "txt": "csv", "bin": "velodyne", "ply": "ply", "nii": "nifti"}
    ending = path.lower().removesuffix(".gz").rpartition(".")[2]
    if ending not in endings:
        raise ValueError(f"cannot tell the format of {path}")
    return endings[ending]


def read_cloud(spark: SparkSession, path: str, file_format: str | None = None, columns: int = 3) -> DataFrame:
    """Points of a file or folder in a format, or the format of its ending."""
    kind = file_format or infer_format(path)
    readers = {"npy": read_npy, "ply": read_ply, "velodyne": read_velodyne, "csv": lambda s, p: read_csv(s, p, columns)}
    if kind not in readers:
        raise ValueError(f"{kind} is no format of clouds; volumes are read by read_volumes")
    return readers[kind](spark, path)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Poses ``(seq, frame, pose array<double>)`` of text files of 12 numbers a line; other lines are passed over.

    The frame is the number of the line among those that count; the sequence is the file's name.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("seq"), F.split("value", r"\r?\n").alias("lines"))
    numbers = F.transform("lines", lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda w: w.try_cast("double")))
    good = F.filter(numbers, lambda n: (F.size(n) == 12) & F.forall(n, lambda x: x.isNotNull()))
    rows = files.select("seq", F.posexplode(good).alias("frame", "n"))
    last = F.array(*[F.lit(float(x)) for x in (0, 0, 0, 1)])
    return rows.select("seq", "frame", F.concat("n", last).alias("pose"))


CASES = (
    "builtin string, input string, format string, methods string, dataset_label string, output string, samples int, max_points int, m int, "
    "selection_c int, k_witness int, max_dim int, rips_points int, seed int, hybrid_alpha double, rips_percentile double, coverage_radius double"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a suite out of a JSON array."""
    return spark.read.schema(CASES).option("multiLine", "true").json(path)


def parse_methods(column: Column) -> Column:
    """Method names out of a comma-separated text, blanks and empty names left out."""
    return F.filter(F.transform(F.split(column, ","), lambda m: F.trim(m)), lambda m: m != "")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of CSV files with headers; columns by name, text and numbers told apart by name."""
    raw = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path)
    return raw.select(*[F.col(c) if c in ("dataset", "method", "batch_label") else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in raw.columns])
