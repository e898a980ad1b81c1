"""FITS images as a source and a sink: files are read whole by Spark and decoded in batches, one image at a time.

Only what the operators need is read: the first header unit with data of two axes or more (of three, the first plane), scaled to doubles; NaN and infinite values become 0
if any value is NaN, negative values 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolign.config import Camera
from astrolign.functions.camera import focal_of_field, focal_of_scale, wcs_tolerance

BLOCK = 2880
_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_CARD = re.compile(r"^([A-Z0-9_-]{1,8}) *= *(?:'((?:[^']|'')*)'|([^/]*))")


def header_of(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Keys of the header that starts at `at`, and where its data start."""
    keys: dict[str, str] = {}
    while at + 80 <= len(data):
        card = data[at : at + 80].decode("latin-1")
        at += 80
        if card.startswith("END") and not card[3:].strip():
            return keys, -(-at // BLOCK) * BLOCK
        if m := _CARD.match(card):
            keys[m[1]] = m[2].replace("''", "'").rstrip() if m[2] is not None else m[3].strip()
    raise ValueError("the header has no end")


def value_type(keys: dict[str, str]) -> tuple[list[int], np.dtype, int]:
    """Lengths of the axes, type and number of the values behind a header."""
    axes = [int(keys[f"NAXIS{k}"]) for k in range(1, int(keys.get("NAXIS", 0)) + 1)]
    return axes, np.dtype(_KINDS[int(keys["BITPIX"])]), int(np.prod(axes)) if axes else 0


def decode(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and image (float64, two axes)."""
    at = 0
    while at < len(data):
        keys, at = header_of(data, at)
        axes, kind, count = value_type(keys)
        if len(axes) >= 2 and count:
            image = np.frombuffer(data, kind, count, at).astype(np.float64).reshape(axes[::-1])
            image = image.reshape(-1, *image.shape[-2:])[0] * float(keys.get("BSCALE", 1)) + float(keys.get("BZERO", 0))
            if np.isnan(image).any():
                image = np.where(np.isfinite(image), image, 0.0)
            return keys, np.maximum(image, 0)
        at += -(-count * kind.itemsize // BLOCK) * BLOCK
    raise ValueError("no image in the file")


def encode(image: np.ndarray, keys: dict[str, object]) -> bytes:
    """A file with one image of doubles."""
    def card(name: str, value: object) -> str:
        text = ("T" if value else "F").rjust(20) if isinstance(value, bool) else f"'{value.replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) else repr(value).upper().rjust(20)
        return f"{name:<8}= {text}"[:80].ljust(80)

    own = {"SIMPLE": True, "BITPIX": -64, "NAXIS": 2, "NAXIS1": image.shape[1], "NAXIS2": image.shape[0], **keys}
    head = "".join(card(k, v) for k, v in own.items()) + "END".ljust(80)
    body = image.astype(">f8").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode("latin-1") + body + bytes(-len(body) % BLOCK)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, header (map of strings), data (binary: little-endian doubles by row), error of each *.fits file. What can't be read gives a row with its error and null data."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(path).select("path", "content"))


def read_paths(paths: DataFrame) -> DataFrame:
    """The same of the files that rows (path: a URI that pyarrow knows) name."""
    out = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(name)
                with where.open_input_file(path) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([stream.read()], pa.binary())], schema=out)

    return decoded(paths.select("path").mapInArrow(run, "path string, content binary"))


def decoded(files: DataFrame) -> DataFrame:
    """read() of files that are there as path, content."""
    out = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("header", pa.map_(pa.string(), pa.string())), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    keys, image = decode(content.as_py())
                    row = name, image.shape[1], image.shape[0], list(keys.items()), image.astype("<f8").tobytes(), None
                except (ValueError, KeyError) as e:
                    row = name, None, None, None, None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

    return files.mapInArrow(run, "path string, width int, height int, header map<string,string>, data binary, error string")


def pixels(frames: DataFrame, key: str = "path", sizes: bool = False) -> DataFrame:
    """frame_id (the key's values), row, col, value of each frame's data; sizes: also the frame's height and width."""
    kind = frames.schema[key].dataType.simpleString()
    kind = kind if kind == "bigint" else "string"
    own = pa.int64() if kind == "bigint" else pa.string()
    names = ["frame_id", "row", "col", "value"] + ["height", "width"] * sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, height, width, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                value = np.frombuffer(data, "<f8")
                place = np.arange(len(value))
                columns = [pa.array([name] * len(value), own), pa.array((place // width).astype(np.int32)), pa.array((place % width).astype(np.int32)), pa.array(value)]
                size = [pa.array(np.full(len(value), n, np.int32)) for n in (height, width)] * sizes
                yield pa.RecordBatch.from_arrays(columns + size, names)

    return frames.where("data IS NOT NULL").select(F.col(key).cast(kind), "height", "width", "data").mapInArrow(run, f"frame_id {kind}, row int, col int, value double" + ", height int, width int" * sizes)


def _scale(header: Column, first: str, second: str) -> Column:
    return F.abs(F.coalesce(*[F.try_element_at(header, F.lit(k)).cast("double") for k in (first, second)]))


def _readable(frames: DataFrame) -> Column:
    """Frames that could be read: of a scan of headers alone, those with a width."""
    return F.col("data" if "data" in frames.columns else "width").isNotNull()


def cameras(frames: DataFrame, key: str = "path", default: Camera = Camera()) -> DataFrame:
    """frame_id, focal, cx, cy, width, height, k1, k2, tolerance of each frame: a synthetic image has the default camera or what its header says, one with a plate scale a camera of that scale without
    distortion and a tolerance of two pixels, any other the default one. A null tolerance stands for the settings' own."""
    h = lambda k: F.try_element_at("header", F.lit(k)).cast("double")
    made = F.coalesce(F.upper(F.try_element_at("header", F.lit("SYNTHIMG"))).isin("T", "TRUE"), F.lit(False))
    focal = focal_of_scale(_scale(F.col("header"), "CD1_1", "CDELT1"))
    real = ~made & focal.isNotNull()
    pick = lambda synthetic, wcs, other: F.when(made, F.coalesce(synthetic, F.lit(float(other)))).when(real, wcs).otherwise(F.lit(float(other)))
    w, t = F.col("width").cast("double"), F.col("height").cast("double")
    own = frames.where(_readable(frames)).select(
        F.col(key).alias("frame_id"), pick(h("FOCAL_L"), focal, default.focal).alias("focal"), pick(h("CX"), w / 2, default.cx).alias("cx"), pick(h("CY"), t / 2, default.cy).alias("cy"), "width", "height",
        F.when(real, 0.0).otherwise(default.k1).alias("k1"), F.when(real, 0.0).otherwise(default.k2).alias("k2"), real.alias("real"),
    )
    fov = 2 * F.degrees(F.atan2(F.col("width") / 2, F.col("focal")))
    return own.withColumn("tolerance", F.when(F.col("real"), wcs_tolerance(fov, F.col("width"), F.col("height")))).drop("real")


def viewer_cameras(frames: DataFrame, key: str = "path", default: Camera = Camera()) -> DataFrame:
    """frame_id, focal, cx, cy, width, height, k1, k2, fov, least_angle, most_angle as a viewer takes them: the focal length by the whole field, the reference pixel as the centre, and pairs from two
    pixels to 1.2 fields, 20 degrees at most. Without a plate scale the default camera, and null angles for the settings' own."""
    h = lambda k: F.try_element_at("header", F.lit(k)).cast("double")
    scale = _scale(F.col("header"), "CDELT1", "CD1_1")
    w, t = F.col("width").cast("double"), F.col("height").cast("double")
    focal, fov = focal_of_field(scale, w, t), scale * F.greatest(w, t)
    real = F.coalesce(scale > 0, F.lit(False))
    pick = lambda wcs, other: F.when(real, wcs).otherwise(F.lit(float(other)))
    return frames.where(_readable(frames)).select(
        F.col(key).alias("frame_id"), pick(focal, default.focal).alias("focal"), pick(F.coalesce(h("CRPIX1"), w / 2), default.cx).alias("cx"), pick(F.coalesce(h("CRPIX2"), t / 2), default.cy).alias("cy"),
        "width", "height", pick(F.lit(0.0), default.k1).alias("k1"), pick(F.lit(0.0), default.k2).alias("k2"), pick(fov, default.fov).alias("fov"),
        F.when(real, 2 * scale).alias("least_angle"), F.when(real, F.least(1.2 * fov, F.lit(20.0))).alias("most_angle"),
    )


def write(frames: DataFrame, folder: str) -> DataFrame:
    """Writes name.fits for each row (name, width, data, header) under `folder`, a URI that executors reach, and returns name, bytes. Writing again gives the same
    file, so a repeated task does no harm."""
    out = pa.schema([("name", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs  # the folder has a scheme that pyarrow knows, as folders of images do

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for name, width, data, header in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                content = encode(np.frombuffer(data, "<f8").reshape(-1, width), dict(header or []))
                with where.open_output_stream(f"{root}/{name}.fits", compression=None) as stream:
                    stream.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], schema=out)

    return frames.select("name", "width", "data", "header").mapInArrow(run, "name string, bytes long")


def from_places(frames: DataFrame) -> DataFrame:
    """name, width, data, header of frames (name, width, height, own: array of struct at, value; header): pixels that `own` lacks are 0. A frame is a row: a sensor bounds it."""
    out = pa.schema([("name", pa.string()), ("width", pa.int32()), ("data", pa.binary()), ("header", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                name, width, height, header = (batch.column(c)[k].as_py() for c in (0, 1, 2, 4))
                image, own = np.zeros(width * height), batch.column(3)[k].values
                image[own.field("at").to_numpy()] = own.field("value").to_numpy(zero_copy_only=False)
                rows.append((name, width, image.astype("<f8").tobytes(), header))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return frames.select("name", F.col("width").cast("int"), F.col("height").cast("int"), "own", "header").mapInArrow(run, "name string, width int, data binary, header map<string,string>")


def names(listed: DataFrame, path: str = "path") -> DataFrame:
    """filename: what follows the last slash."""
    return listed.withColumn("filename", F.element_at(F.split(path, "/"), -1))
