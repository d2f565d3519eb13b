"""Files as they arrive, and codecs whose input comes in chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.kernels.codecs import PackBits

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_media_stream(spark: SparkSession, folder: str, glob: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """(path, length, content) of files as they come into the folder; parts() and tags() of sources.media take it."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch)
    return stream.load(folder).select("path", "length", "content")


def unpack_stream(chunks: DataFrame, key: str = "stream_id", order: str = "seq", data: str = "data", last: str = "last") -> DataFrame:
    """(stream_id, seq, data): PackBits chunks decoded as they come; what a chunk leaves unfinished is the stream's state.

    Chunks of a stream come in order of seq from one batch to the next; within a batch they are sorted.  The row that says
    it is the last ends the stream and drops its state."""

    def run(k: tuple, frames, state: GroupState):
        own = PackBits()
        own.held = bytes(state.get[0]) if state.exists else b""
        rows, ended = [], False
        for frame in frames:
            for r in frame.sort_values(order).to_dict("records"):
                out = own.add(bytes(r[data]))
                if r[last]:
                    out, ended = out + own.finish(), True
                rows.append({key: k[0], order: r[order], data: out})
        if ended:
            state.remove()
        else:
            state.update((own.held,))
        yield pd.DataFrame(rows, columns=[key, order, data])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} long, {data} binary", "held binary", "append", GroupStateTimeout.NoTimeout)
