"""FITS images as a Spark data source, `spark.read.format("fits")` and `df.write.format("fits")`.

Reading: partitions are planned from sizes of files alone. Only the columns of the given schema are read: without `data` a file costs its header's blocks, whatever its size. With it, images beyond `bandBytes` come as bands of rows, each
read by its own byte range, so that no row, and no task, has to hold a large frame. Values are those of fits.decode().

Writing: rows (name, width, data; header) become name.fits. Tasks write below a temporary folder; the commit moves what successful attempts wrote, an abort removes it all, so a failed job leaves no file.

The folder is a URI that executors reach and pyarrow knows (a local path, file:, hdfs:, s3:, gs:). fits.read() reads whole files through Spark's own file systems where that doesn't hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from astrolign.sources.fits import BLOCK, encode, header_of, value_type

COLUMNS = {"path": "string", "width": "int", "height": "int", "first_row": "int", "header": "map<string,string>", "data": "binary", "error": "string", "bytes_read": "long"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
#: A file counts as this much more when files are packed into partitions: what it costs to open it.
OPEN_COST = 256 << 10


@dataclass
class Slice:
    """Part k of n of a file's rows."""

    path: str
    k: int
    n: int


class Files(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


class _Counted:
    """A file that counts the bytes that are read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.read = stream, stream.size(), 0

    def at(self, offset: int, n: int) -> bytes:
        data = self.stream.read_at(n, offset)
        self.read += len(data)
        return data


def image_header(file: _Counted) -> tuple[dict[str, str], int, tuple[int, int], np.dtype]:
    """Header of the first image, the place of its values, height and width, and their type. Headers are read block by block, the data between them are skipped."""
    at = 0
    while at < file.size:
        raw = file.at(at, BLOCK)
        while True:
            try:
                keys, end = header_of(raw, 0)
                break
            except ValueError:
                more = file.at(at + len(raw), BLOCK)
                if not more:
                    raise
                raw += more
        axes, kind, count = value_type(keys)
        at += end
        if len(axes) >= 2 and count:
            if at + count * kind.itemsize > file.size:
                raise ValueError("the image is cut off")
            return keys, at, (axes[1], axes[0]), kind
        at += -(-count * kind.itemsize // BLOCK) * BLOCK
    raise ValueError("no image in the file")


def band(file: _Counted, keys: dict[str, str], at: int, shape: tuple[int, int], kind: np.dtype, first: int, last: int) -> np.ndarray:
    """Rows first to last of an image as doubles: NaN and infinite values are 0 if any value of the whole image is NaN, negative ones 0."""
    (height, width), scale, zero = shape, float(keys.get("BSCALE", 1)), float(keys.get("BZERO", 0))

    def rows(a: int, b: int) -> np.ndarray:
        return np.frombuffer(file.at(at + a * width * kind.itemsize, (b - a) * width * kind.itemsize), kind).astype(np.float64).reshape(-1, width) * scale + zero

    image = rows(first, last)
    odd = ~np.isfinite(image)
    if odd.any():
        holds_nan = np.isnan(image).any()
        step = max(1, last - first)
        others = ((a, min(a + step, height)) for a in range(0, height, step) if not first <= a < last)
        if holds_nan or any(np.isnan(rows(a, b)).any() for a, b in others):  # infinite values alone stay: only then the rest matters
            image = np.where(odd, 0.0, image)
    return np.maximum(image, 0)


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = [f.name for f in schema.fields], options
        unknown = set(self.columns) - set(COLUMNS)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}; a FITS source has {', '.join(COLUMNS)}")
        self.schema = pa.schema([(c, _TYPES[c]) for c in self.columns])

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        option = {k.lower(): v for k, v in self.options.items()}
        most, large = int(option.get("partitionbytes", 64 << 20)), int(option.get("bandbytes", 64 << 20))
        where, root = fs.FileSystem.from_uri(option["path"])
        head = option["path"].split("://", 1)[0] + "://" if "://" in option["path"] else "file:" if option["path"].startswith("file:") else ""
        listed = where.get_file_info(fs.FileSelector(root, allow_not_found=False))
        files = sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and f.path.endswith(".fits"))
        planned, held, cost = [], [], 0
        for path, size in files:
            n = max(1, -(-size // large)) if "data" in self.columns else 1
            for k in range(n):
                own = OPEN_COST + (size // n if "data" in self.columns else BLOCK)
                if held and cost + own > most:
                    planned.append(Files(held))
                    held, cost = [], 0
                held.append(Slice(head + path, k, n))
                cost += own
        return [*planned, Files(held)] if held or not planned else planned

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for own in partition.slices:
            where, path = fs.FileSystem.from_uri(own.path)
            row = dict.fromkeys(COLUMNS) | {"path": own.path}
            with where.open_input_file(path) as stream:
                file = _Counted(stream)
                try:
                    keys, at, (height, width), kind = image_header(file)
                    first, last = height * own.k // own.n, height * (own.k + 1) // own.n
                    row |= {"width": width, "height": height, "first_row": first, "header": list(keys.items())}
                    if "data" in self.columns:
                        if first == last:
                            continue
                        row["data"] = band(file, keys, at, (height, width), kind, first, last).astype("<f8").tobytes()
                except (ValueError, KeyError) as e:
                    if own.k:
                        continue  # the first part tells of the error
                    row |= {c: None for c in ("width", "height", "first_row", "header", "data")} | {"error": f"{type(e).__name__}: {e}"}
                row["bytes_read"] = file.read
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], _TYPES[c]) for c in self.columns], schema=self.schema)


_TYPES = {
    "path": pa.string(), "width": pa.int32(), "height": pa.int32(), "first_row": pa.int32(), "header": pa.map_(pa.string(), pa.string()), "data": pa.binary(), "error": pa.string(), "bytes_read": pa.int64(),
}


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote."""

    attempt: str
    names: list[str]


class FitsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        missing = {"name", "width", "data"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows to be written as FITS lack {', '.join(sorted(missing))}")
        self.folder, self.overwrite, self.job = options["path"], overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(self.folder)
        attempt, names = str(TaskContext.get().taskAttemptId()), []
        where.create_dir(f"{root}/{self.job}/{attempt}", recursive=True)
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("name", "width", "data")]
            headers = batch.column("header").to_pylist() if "header" in batch.schema.names else [None] * batch.num_rows
            for name, width, data, header in zip(*columns, headers, strict=True):
                if not name or "/" in name:
                    raise ValueError(f"no name for a file: {name!r}")
                with where.open_output_stream(f"{root}/{self.job}/{attempt}/{name}.fits", compression=None) as stream:
                    stream.write(encode(np.frombuffer(data, "<f8").reshape(-1, width), dict(header or [])))
                names.append(name)
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.folder)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        where.create_dir(root, recursive=True)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and f.path.endswith(".fits"):
                    where.delete_file(f.path)
        for m in filter(None, messages):
            for name in m.names:
                where.move(f"{root}/{self.job}/{m.attempt}/{name}.fits", f"{root}/{name}.fits")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.folder)
        if where.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.job}")


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(dict(self.options), schema, overwrite)


def scan(spark: SparkSession, path: str, *columns: str, **options: object) -> DataFrame:
    """The given columns (all but none are given) of the *.fits files of a folder; what isn't asked for isn't read. options: partitionBytes, bandBytes."""
    spark.dataSource.register(FitsSource)
    return spark.read.format("fits").schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns or COLUMNS)).options(**options).load(path)


def save(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """name.fits for each row (name, width, data, header): all of them, or none."""
    frames.sparkSession.dataSource.register(FitsSource)
    columns = [c for c in ("name", "width", "data", "header") if c in frames.columns]
    frames.select(*columns).write.format("fits").mode("overwrite" if overwrite else "append").save(path)
