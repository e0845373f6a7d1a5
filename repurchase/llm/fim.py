"""Fill-in-middle: texts are cut into prefix, middle and suffix, and the blocks change places in the buffer itself.

A text becomes one bytearray. A scan over its bytes finds the ends of its tokens (blanks and the word behind them; blanks
at the end are a token of their own), a hash of the document's id says after how many tokens to cut, and the three
sentinels are inserted at the cuts, each before the block it names. Blocks then change places by rotation: reverse both
blocks, then the whole. That takes the order prefix, middle, suffix to prefix, suffix, middle (psm) or to suffix, prefix,
middle (spm). ``restore`` finds the sentinels, rotates back and deletes them, which gives the exact text again.

A task holds one text and its output besides the batch Spark hands over; reversals swap chunks of ``CHUNK`` bytes.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays as it is (form plain);
a text of blanks is one token; very long texts are cut like any other; rows that repeat an id and a text get the same
output, rows without id are cut as if the id were written with no digits; an empty table gives no rows. Columns of the
input other than those named in ``keep`` are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.llm.neardup import text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SEED = 42
# Of 100 documents, how many are transformed, and of 100 transformed ones, how many begin with the suffix.
RATE, SPM_RATE = 50, 80
CHUNK = 1 << 16
SLICE_BYTES = 8 << 20
FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def token_ends(data: np.ndarray) -> np.ndarray:
    """The byte after each token. Blanks are single bytes in UTF-8, so no character is ever cut."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # The last byte ends the last word, or the blanks behind it.
    return np.append(ends, len(data))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on seed and id alone."""
    written = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(written[at : at + 8], 16) for at in range(0, 32, 8)]


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes but those that continue one."""
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place, a chunk at each side at a time."""
    while end - start > 1:
        step = min(CHUNK, (end - start) // 2)
        head = view[start : start + step].copy()
        view[start : start + step] = view[end - step : end][::-1]
        view[end - step : end] = head[::-1]
        start, end = start + step, end - step


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks [start, middle) and [middle, end) by three reversals."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def transform_bytes(buffer: bytearray, doc_id: int | None, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None]:
    """Change ``buffer`` into its output; returns tokens, form, characters of prefix and of middle."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    ends = token_ends(data)
    n = len(ends)
    h = draws(doc_id, seed)
    if not n or h[2] % 100 >= rate or any(mark in buffer for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    counts = characters(data[:a]), characters(data[a:b])
    # A bytearray cannot grow while something looks at its memory.
    del data
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    a, b, end = a + MARK, b + 2 * MARK, len(buffer)
    if h[3] % 100 < spm_rate:
        rotate(buffer, 0, b, end)
        return n, "spm", *counts
    rotate(buffer, a, b, end)
    return n, "psm", *counts


def restore_bytes(buffer: bytearray, form: str) -> None:
    """Change an output back into its text."""
    if form == "plain":
        return
    middle, end = buffer.index(MIDDLE), len(buffer)
    if form == "spm":
        # suffix, prefix, middle: the first block goes to the end.
        b = end - buffer.index(PREFIX)
        a = b - (end - middle)
        rotate(buffer, 0, end - b, end)
    elif form == "psm":
        a = buffer.index(SUFFIX)
        b = a + end - middle
        rotate(buffer, a, middle, end)
    else:
        raise ValueError(f"no form {form!r}")
    del buffer[b : b + MARK]
    del buffer[a : a + MARK]
    del buffer[:MARK]


def _strings(buffers: list[bytearray]) -> pa.Array:
    offsets = np.zeros(len(buffers) + 1, dtype=np.int32)
    np.cumsum([len(b) for b in buffers], out=offsets[1:])
    return pa.StringArray.from_buffers(len(buffers), pa.py_buffer(offsets), pa.py_buffer(b"".join(buffers)))


def transform(documents: DataFrame, *keep: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id and the kept columns, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    names = list(dict.fromkeys(("doc_id", *keep)))
    rows = documents.select(*names, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    clash = {f.name for f in kept} & {f.name for f in FIELDS}
    if clash:
        raise ValueError(f"rename before keeping: {sorted(clash)}")
    out = T.StructType(kept + FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_slices(batch, "_text", SLICE_BYTES):
                ids = batch.column("doc_id")[i:j].to_pylist()
                buffers = [bytearray(data[x:y]) for x, y in zip(at[:-1], at[1:])]
                found = [transform_bytes(b, d, seed, rate, spm_rate) for b, d in zip(buffers, ids)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                own = [batch.column(f.name)[i:j] for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *columns, _strings(buffers)], names=out.names)

    return rows.mapInArrow(run, out)


def restore(transformed: DataFrame, name: str = "restored") -> DataFrame:
    """Add the text from which ``output`` was made, read from ``output`` and ``form`` alone."""
    out = T.StructType(transformed.schema.fields + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_slices(batch, "output", SLICE_BYTES):
                buffers = [bytearray(data[x:y]) for x, y in zip(at[:-1], at[1:])]
                for buffer, form in zip(buffers, batch.column("form")[i:j].to_pylist()):
                    restore_bytes(buffer, form)
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns), _strings(buffers)], names=out.names)

    return transformed.mapInArrow(run, out)
