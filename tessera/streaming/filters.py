"""Codecs by name: as functions of SQL, and as objects that take their input in chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.kernels import codecs, raster

ROW, STEP = 64, 1  # bytes of a row and samples of a pixel for the predictor by name


class Predictor:
    """Differences undone row by row; a row that is not whole waits."""

    def __init__(self, row: int = ROW, step: int = STEP) -> None:
        self.row, self.step, self.held = row, step, b""

    def add(self, chunk: bytes) -> bytes:
        data = self.held + chunk
        whole = len(data) // self.row * self.row
        self.held = data[whole:]
        if not whole:
            return b""
        return raster.unpredict(np.frombuffer(data[:whole], np.uint8).reshape(-1, self.row), self.step).tobytes()

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return raster.unpredict(np.frombuffer(rest, np.uint8)[None], self.step).tobytes() if rest else b""


def predictor_encode(data: bytes, row: int = ROW, step: int = STEP) -> bytes:
    return b"".join(raster.predict(np.frombuffer(data[i : i + row], np.uint8)[None], step).tobytes() for i in range(0, len(data), row))


def predictor_decode(data: bytes) -> bytes:
    own = Predictor()
    return own.add(data) + own.finish()


FILTERS = {
    "lzw_encode": codecs.Lzw.encode,
    "lzw_decode": codecs.Lzw.decode,
    "packbits_encode": codecs.PackBits.encode,
    "packbits_decode": codecs.PackBits.decode,
    "predictor_encode": predictor_encode,
    "predictor_decode": predictor_decode,
}
INCREMENTAL = {"lzw": codecs.Lzw, "packbits": codecs.PackBits, "predictor": Predictor}


def _batchwise(kernel):
    def own(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else kernel(v) for v in values.to_pylist()], pa.binary())

    own.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(own, "binary")


def register(spark: SparkSession, prefix: str = "tessera_") -> list[str]:
    """Each codec as a function of binary values, a batch at a time; names that are there already are replaced by the same."""
    for name, kernel in FILTERS.items():
        spark.udf.register(f"{prefix}{name}", _batchwise(kernel))
    return [f"{prefix}{n}" for n in FILTERS]
