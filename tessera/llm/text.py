"""Shared helpers: word splitting on UTF-8 bytes and Arrow batch mapping.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: every
other ASCII byte becomes a space, so `bytes.split` finds them without a regex.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import checkpointed  # noqa: F401

#: Texts are handled in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 2_000_000

_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return text.translate(_WORD_TABLE).split() if text else []


def blank_tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased tokens `[^\\x20\\x09-\\x0D]+`; none for null."""
    return text.translate(_LOWER_TABLE).split() if text else []


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    start = held = 0
    for i, n in enumerate(sizes.to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_bytes(array: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    kernel: Callable[[dict[str, pa.Array]], dict[str, object]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of df with the columns that the kernel computes, batch by batch.

    kernel: from the Arrow arrays of `inputs` (the first is the text, by which
    batches are sliced) to a sequence or Arrow array for each field. keep: the
    columns to pass through, all by default; those that clash with a new column
    (in any case) are replaced by it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    packed = df.select(
        *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)],
        *[F.col(quoted(c)).alias(f"i{i}") for i, c in enumerate(inputs)],
    )
    plain = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
        + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, "i0"):
                at = part.schema.get_field_index
                out = kernel({c: part.column(at(f"i{i}")) for i, c in enumerate(inputs)})
                arrays = [part.column(at(f"k{i}")) for i in range(len(kept))]
                for f, kind in zip(fields, kinds, strict=True):
                    x = out[f.name]
                    arrays.append(x if isinstance(x, pa.Array) else pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in plain])

    done = packed.mapInArrow(run, plain)
    return done.toDF(*[f.name for f in schema])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
