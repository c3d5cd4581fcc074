"""Fill-in-the-middle documents by rotation in place.

A text is cut into units `[A-Za-z]+|[^A-Za-z]`: a class table over its UTF-8 bytes
marks where units start (a byte that continues neither a code point nor a run of
letters), so a cut after so many units is a byte offset. Sentinels go into one
bytearray in the text's own order, `<P>`prefix`<M>`middle`<S>`suffix, and two
neighbouring blocks change places by three reversals: the last two give
`<P>`prefix`<S>`suffix`<M>`middle (psm), the first two together and the last
`<S>`suffix`<P>`prefix`<M>`middle (spm). The inverse finds the sentinels, which no
such text holds otherwise and which no text next to a sentinel completes (they start
with `<` and have none inside), rotates back and takes them out.

Cuts and forms come from the hash of `seed:id`, so they don't depend on order or
partitions and a lost task makes the same rows again.

Nulls and edges: a null text is like an empty one, plain; a null id hashes as if
it were empty; texts with a sentinel are plain; rows that repeat an id and its text
are treated alike; columns whose names clash with new ones are replaced.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns, as_bytes, quoted

#: Sentinels, fixed values.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100: from this on a text stays plain; below this the suffix comes first.
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_CONTINUES = np.array([b >> 6 == 2 for b in range(256)])


def reverse(block: np.ndarray, start: int, end: int) -> None:
    """The bytes from start to end in the opposite order, in place."""
    half = (end - start) // 2
    left, right = block[start : start + half], block[end - half : end]
    held = left.copy()
    left[:] = right[::-1]
    right[:] = held[::-1]


def rotate(block: np.ndarray, start: int, cut: int, end: int) -> None:
    """The segments [start, cut) and [cut, end) exchanged in place by three reversals."""
    reverse(block, start, cut)
    reverse(block, cut, end)
    reverse(block, start, end)


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which units start."""
    b = np.frombuffer(text, dtype=np.uint8)
    letter = _LETTER[b]
    start = ~_CONTINUES[b]
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def code_points(text: bytes) -> int:
    return len(text) - int(np.count_nonzero(_CONTINUES[np.frombuffer(text, dtype=np.uint8)]))


def choices(key: str) -> list[int]:
    """The first four groups of eight digits of the key's hash."""
    digest = sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def formatted(text: bytes, key: str) -> tuple[bytes, int, str, int | None, int | None]:
    """output, n units, form, code points of prefix and middle."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = choices(key)
    if not n or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return text, n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(starts[c]) if c < n else len(text) for c in (low, high))
    out = bytearray(PREFIX + text[:a] + MIDDLE + text[a:b] + SUFFIX + text[b:])
    middle, suffix = len(PREFIX) + a, len(PREFIX) + len(MIDDLE) + b
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    rotate(np.frombuffer(out, dtype=np.uint8), 0 if form == "spm" else middle, suffix, len(out))
    return bytes(out), n, form, code_points(text[:a]), code_points(text[a:b])


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    block = bytearray(output)
    first = 0 if form == "spm" else output.index(SUFFIX)
    # The suffix goes back to the end: it stands before the prefix or before the middle.
    rotate(np.frombuffer(block, dtype=np.uint8), first, output.index(PREFIX if form == "spm" else MIDDLE), len(block))
    middle = block.index(MIDDLE)
    suffix = block.index(SUFFIX, middle)
    return bytes(block[len(PREFIX) : middle] + block[middle + len(MIDDLE) : suffix] + block[suffix + len(SUFFIX) :])


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """docs with output, n, form, prefix_chars, middle_chars."""
    fields = [T.StructField("output", T.StringType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]

    def kernel(columns: dict[str, pa.Array]) -> dict[str, object]:
        texts, keys = as_bytes(columns[text_col]), columns["_key_"].to_pylist()
        out, *rest = zip(*[formatted(t or b"", k) for t, k in zip(texts, keys, strict=True)], strict=True)
        return {"output": _strings(list(out))} | dict(zip(("n", "form", "prefix_chars", "middle_chars"), rest, strict=True))

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")))
    return add_columns(docs.withColumn("_key_", key), [text_col, "_key_"], fields, kernel, keep=docs.columns)


def restore(formatted_docs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """formatted_docs with restored, the text rebuilt from output and form alone."""

    def kernel(columns: dict[str, pa.Array]) -> dict[str, object]:
        pairs = zip(as_bytes(columns[output_col]), columns[form_col].to_pylist(), strict=True)
        return {"restored": _strings([rebuilt(o or b"", f or "plain") for o, f in pairs])}

    return add_columns(formatted_docs, [output_col, form_col], [T.StructField("restored", T.StringType())], kernel)


def report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    done = restore(transform(docs.select("doc_id", "text"), seed=seed).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256")
    )
