"""Vectorised work on many texts at once: byte blocks, words, hashes.

Texts stay UTF-8 bytes.  A block is a run of rows of about ``BLOCK`` bytes laid end to end, so that arrays of
eight bytes per text byte stay small whatever an Arrow batch holds.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 21
U = np.uint64

WORD_BYTES = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
DARK_BYTES = np.ones(256, bool)  # [^\x20\x09-\x0D]
DARK_BYTES[0x20] = DARK_BYTES[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(text: str = "text") -> Column:
    """With doc_id, names a row across scans; equal rows share it, which no operator minds."""
    return F.xxhash64(F.col(text))


def neutral(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with all columns but ``keep`` under names no operator uses, and the way back to its own names."""
    given = df.columns
    names = [c if c in keep else f"carried_{k}_" for k, c in enumerate(given)]
    return df.toDF(*names), lambda out: out.select(*names).toDF(*given)


@dataclass
class Block:
    first: int  # row of the batch
    offsets: np.ndarray  # rows + 1 places in data
    data: np.ndarray  # uint8

    def __len__(self) -> int:
        return len(self.offsets) - 1


#: Caches of this Python worker that other work may drop.
CACHES: list[dict] = []


def give_back() -> None:
    """Drops the caches of operators that this worker ran before; workers outlive tasks, jobs and operators."""
    if any(CACHES):
        for cache in CACHES:
            cache.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.cast(column, pa.binary()) if pa.types.is_string(column.type) else column, pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Runs of whole rows of at most ``limit`` bytes; a longer text stands alone."""
    give_back()
    offsets, data = binary_parts(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Block(row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]])
        row = end


def spans(block: Block, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes of a kind; runs end where a row ends."""
    inside = np.zeros(len(block.data) + 1, bool)
    inside[:-1] = kind[block.data]
    before = np.zeros(len(block.data) + 1, bool)
    before[1:] = inside[:-1]
    edges = block.offsets[block.offsets < len(block.data)]
    starts = inside & ~before
    starts[edges] |= inside[edges]
    ends = before & ~inside
    cut = block.offsets[1:]
    cut = cut[cut > 0]
    ends[cut] |= before[cut]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            all_ = np.full(size, base, U)
            all_[0] = 1
            _POWERS[name] = np.cumprod(all_, dtype=U)
        if size > 4 * BLOCK:  # not kept for one long text
            return _POWERS.pop("up"), _POWERS.pop("down")
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes; ``span_hash`` takes any span's hash from it."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), U)
    for k in range(n):
        out = mixed(out * U(_BASE) + words[k : k + len(out)])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any [start, end)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole groups; the rows come sorted by the keys, which are not null."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        new = np.zeros(whole.num_rows - 1, bool)
        for key in keys:
            new |= np.diff(whole.column(key).to_numpy()) != 0
        cuts = np.flatnonzero(new) + 1
        last = 0
        if len(cuts):
            for cut in [*cuts[np.searchsorted(cuts, np.arange(rows, int(cuts[-1]), rows), "left")].tolist(), int(cuts[-1])]:
                if cut > last:
                    yield whole.slice(last, cut - last)
                    last = cut
        held = [whole.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks()
