"""Model files of named tensors as a source: one row per tensor."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the file format: version, sizes of the header, of an index entry and of a name in it, code of 32-bit floats.
VERSION, HEADER, ENTRY, NAME, FLOAT32 = 1, 64, 128, 64, 0
_SCHEMA = "path string, name string, shape array<int>, data array<float>, checksum_ok boolean"


class TensorFileError(ValueError):
    """A file that isn't a model file, or holds what can't be read."""


def _tensors(content: bytes, magic: bytes) -> Iterator[tuple[str, list[int], np.ndarray, bool]]:
    if content[: len(magic)] != magic:
        raise TensorFileError("not a model file")
    version, count = struct.unpack_from("<II", content, 10)
    if version != VERSION:
        raise TensorFileError(f"unsupported version {version}")
    seen = set()
    for i in range(count):
        entry = content[HEADER + i * ENTRY : HEADER + (i + 1) * ENTRY]
        name = entry[:NAME].split(b"\0")[0].decode()
        kind, rank = entry[64], entry[65]
        *dims, offset, length, checksum = struct.unpack_from("<4IQQI", entry, 68)
        shape = list(dims[:rank])
        if not name or name in seen:
            raise TensorFileError(f"empty or repeated name {name!r}")
        if kind != FLOAT32 or length != 4 * int(np.prod(shape)):
            raise TensorFileError(f"{name}: only whole tensors of 32-bit floats can be read")
        seen.add(name)
        blob = content[offset : offset + length]
        yield name, shape, np.frombuffer(blob, "<f4"), checksum in (0, zlib.crc32(blob))


def read_tensors(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """path, name, shape, data, checksum_ok of every tensor in the files at `path`; an unset checksum (0) is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, shape, data, right in _tensors(content.as_buffer().to_pybytes(), magic):
                    yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([name]), pa.array([shape], pa.list_(pa.int32())), pa.array([data], pa.list_(pa.float32())), pa.array([right])], ["path", "name", "shape", "data", "checksum_ok"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCHEMA)
