"""Table access, shared scratch tables and Arrow batch helpers for the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from provisio.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the folder that the cluster shares (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends here, statistics are kept and a lost
    executor replays nothing that came before.  `narrow`, for rows of a few ids: at most four files per core."""
    path = shared_folder(df.sparkSession, name)
    if narrow:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(taken: list[str], name: str) -> str:
    """`name`, with underscores in front until it clashes with no column."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings of an Arrow column, end to end, and n + 1 offsets (int64).  Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type) or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs * 0
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Cut a record batch into runs of rows whose texts total `max_bytes` at most (a longer single text comes alone), so
    that work arrays stay small whatever the batch size."""
    _, offs = flat(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


#: White space that ends a word, in UTF-8.
SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 22


def pieces(data: bytes, gap: re.Pattern = SPACE_BYTE, size: int | None = None):
    """A text in pieces of about `size` bytes, cut at gaps only (the gap's byte is left out), so that lists of its words stay
    small however long it is."""
    at, size = 0, size or PIECE
    while len(data) - at > size:
        end = gap.search(data, at + size)
        if not end:
            break
        yield data[at:end.start()]
        at = end.end()
    yield data[at:] if at else data
