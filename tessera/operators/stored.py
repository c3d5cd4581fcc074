"""Tables below the checkpoint folder that tasks read by themselves, so that what meets everything is not shuffled for it.

The folder is shared by the driver and all executors (ordering.checkpoint_folder); files are opened with pyarrow's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from tessera.operators.ordering import checkpoint_folder, checkpointed
from tessera.sources.binary import file_system

Files = list[tuple[str, int]]


def stored(df: DataFrame) -> tuple[DataFrame, Files]:
    """df cut from its lineage, and its files in their order with their numbers of rows."""
    folder = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df = checkpointed(df, folder)
    store, at = file_system(folder)
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))
    files = []
    for name in names:
        with store.open_input_file(f"{at}/{name}") as f:
            files.append((f"{folder}/{name}", pq.read_metadata(f).num_rows))
    return df, files


def batches(files: Files, columns: list[str], start: int = 0, stop: int | None = None, size: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Rows start to stop of all files in their order, at most so many at once."""
    at = 0
    for name, rows in files:
        if rows and at + rows > start and (stop is None or at < stop):
            store, path = file_system(name)
            with store.open_input_file(path) as f:
                place = at
                for batch in pq.ParquetFile(f).iter_batches(batch_size=size, columns=columns):
                    low, high = max(start - place, 0), batch.num_rows if stop is None else min(stop - place, batch.num_rows)
                    if low < high:
                        yield batch.slice(low, high - low)
                    place += batch.num_rows
                    if stop is not None and place >= stop:
                        break
        at += rows
