"""Vectorised words, lines, windows and hashes over UTF-8 column buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those bytes
never occur inside a multi-byte character, so byte runs are exactly the runs of
characters. Hashes are 64 bits: a prefix-sum polynomial over the bytes, then a
mixing step; equality of hashes is taken as equality of content.

Memory: a chunk is at most CHUNK_BYTES of short texts, or one longer text. Bytes
are hashed in blocks, with the value of a span that crosses blocks carried on, so
tables grow with a block; a long text costs its bytes and some arrays of one
element for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 512 << 10
#: Bytes hashed at a time.
BLOCK = 256 << 10
#: Elements of an array that are worked on at a time.
STRIP = 1 << 16
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_LEN = 0xA0761D6478BD642F

SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    """The first BLOCK + 1 powers of ``base``."""
    out = np.full(BLOCK + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_R), _powers(_R_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's final step)."""
    x = x.astype(np.uint64, copy=True)
    for k in range(0, len(x), STRIP):
        v = x[k : k + STRIP]
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of ``x`` in order; ``x`` itself is sorted."""
    x.sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``offsets``."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(flags)])
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        end = int(offsets[full[-1] + 1])
        out[full] = np.add.reduceat(flags[:end], offsets[full], dtype=np.int64)
    return out


class Chunk:
    """Some whole texts: ``data`` holds their bytes, ``offsets`` where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.rows = len(offsets) - 1
        self.solid = SOLID[self.data]
        self.starts, self.ends = self._edges()
        #: where each row's words begin among all words
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)

    def _blocks(self) -> Iterator[tuple[int, int]]:
        n = len(self.data)
        return ((k, min(n, k + BLOCK)) for k in range(0, n, BLOCK))

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends; a row's end ends a word."""
        solid, n = self.solid, len(self.data)
        kind = np.int32 if n < 1 << 31 else np.int64
        starts, ends = [np.empty(0, kind)], [np.empty(0, kind)]
        heads, tails = self.offsets[:-1], self.offsets[1:] - 1
        for lo, hi in self._blocks():
            part = solid[lo:hi]
            first, last = part.copy(), part.copy()
            first[1:] &= ~part[:-1]
            first[0] &= not (lo and solid[lo - 1])
            last[:-1] &= ~part[1:]
            last[-1] &= not (hi < n and solid[hi])
            for flags, rows in ((first, heads), (last, tails)):
                at = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi)] - lo
                flags[at] = part[at]
            starts.append((np.flatnonzero(first) + lo).astype(kind))
            ends.append((np.flatnonzero(last) + (lo + 1)).astype(kind))
        return np.concatenate(starts), np.concatenate(ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes, which are in order and don't overlap."""
        out = np.zeros(len(starts), np.uint64)
        for lo, hi in self._blocks():
            a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi))
            if a >= b:
                continue
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * _UP[: hi - lo], out=sums[1:])
            first, last = np.maximum(starts[a:b], lo) - lo, np.minimum(ends[a:b], hi) - lo
            part = (sums[last] - sums[first]) * _DOWN[first]
            if starts[a] < lo:  # goes on from the block before
                part[0] = np.uint64(int(part[0]) * pow(_R, lo - int(starts[a]), 1 << 64) & (1 << 64) - 1)
            out[a:b] += part
        out += (ends - starts).astype(np.uint64) * np.uint64(_LEN)
        return mix(out)

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def windows(self, width: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all full windows of ``width`` words inside one row, and the
        index of each window's first word."""
        words = self.word_hashes() if words is None else words
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        value = np.full(n, np.uint64(width * _LEN & (1 << 64) - 1))
        steps = [np.uint64(pow(_STEP, j + 1, 1 << 64)) for j in range(width)]
        for k in range(0, n, STRIP):
            part = value[k : k + STRIP]
            for j, step in enumerate(steps):
                part += words[k + j : k + j + len(part)] * step
        if self.rows == 1:
            return mix(value), np.arange(n, dtype=np.int32)
        whole = np.ones(n, bool)
        for edge in self.word_offsets[1:-1]:
            whole[max(0, edge - width + 1) : edge] = False
        at = np.flatnonzero(whole)
        return mix(value[at]), at

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """Per row the sorted distinct hashes of its ``width``-word shingles; of
        its whole word sequence if it has fewer words; empty without words."""
        words = self.word_hashes()
        value, at = self.windows(width, words)
        bounds = np.searchsorted(at, self.word_offsets)
        out = []
        for row, n in enumerate(self.n_words.tolist()):
            if n >= width:
                out.append(distinct(value[bounds[row] : bounds[row + 1]]))
            elif n:
                first = self.word_offsets[row]
                total = n * _LEN
                for j in range(n):
                    total += int(words[first + j]) * pow(_STEP, j + 1, 1 << 64)
                out.append(mix(np.array([total & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and row of every \n-split line of every row."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        row = np.concatenate([np.arange(self.rows), np.searchsorted(self.offsets, breaks, "right") - 1])
        row.sort()
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.append(np.flatnonzero(np.diff(row)), len(row) - 1) if len(row) else np.empty(0, int)
        ends[last] = self.offsets[1:]
        return starts, ends, row


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, row after the last, chunk) over ``column``; a chunk holds at
    most CHUNK_BYTES of text, or one longer text."""
    data, offsets = column_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), rows)
        part = offsets[first : last + 1]
        yield first, last, Chunk(data[part[0] : part[-1]], part - part[0], lower)
        first = last


#: Rows that Spark hands to Python at a time. Its default of 10,000 would make
#: batches of tens of MB of documents, held off the heap and again in the worker.
BATCH_ROWS = 1000


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` itself; from now on its session hands over at most ``rows`` rows at a time."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    now = int(conf.get(key))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))
    return df


def map_texts(
    df: DataFrame,
    make: Callable[[Chunk], dict[str, object]],
    fields: str,
    keep: list[str],
    text: str = "text",
    lower: bool = False,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and, from each chunk of column ``text``, the
    columns named in ``fields`` that ``make`` returns one value a row for."""
    chosen = small_batches(df).select(*[df[c] for c in keep if c != text], df[text])
    made = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    schema = T.StructType([f for f in chosen.schema.fields if f.name in keep] + made.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, last, chunk in chunks(column, lower):
                out = make(chunk)
                part = batch.slice(first, last - first)
                arrays = [part.column(part.schema.get_field_index(n)) if n not in out else _array(out[n]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return chosen.mapInArrow(run, schema)


def _array(values: object) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


TEXT_STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, "
    "n_upper long, n_lower long, n_digits long, n_pipes long, n_bangs long, n_symbol_ends long, n_bang_ends long, n_echo long, n_distinct long"
)


def text_stats(chunk: Chunk, window: int = 8) -> dict[str, np.ndarray]:
    """The statistics of TEXT_STATS, one value for each row of ``chunk``."""
    data, offsets, word_offsets = chunk.data, chunk.offsets, chunk.word_offsets
    point = (data & 0xC0) != 0x80
    words = chunk.word_hashes()
    owner = np.repeat(np.arange(chunk.rows, dtype=np.int32), chunk.n_words)
    tag = mix(np.arange(1, chunk.rows + 1, dtype=np.uint64))

    def kinds(values: np.ndarray, row: np.ndarray) -> np.ndarray:
        if chunk.rows == 1:
            return np.array([len(distinct(values.copy()))])
        order = np.argsort(values ^ tag[row])
        keyed = (values ^ tag[row])[order]
        new = np.ones(len(keyed), bool)
        new[1:] = keyed[1:] != keyed[:-1]
        return np.bincount(row[order][new], minlength=chunk.rows)

    starts, ends, line_row = chunk.lines()
    filled = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    starts, ends, line_owner = starts[filled], ends[filled], line_row[filled]
    dup_lines = np.bincount(line_owner, minlength=chunk.rows) - kinds(chunk.span_hashes(starts, ends), line_owner)

    value, at = chunk.windows(window, words)
    if chunk.rows > 1 and len(at):
        value ^= tag[owner[at]]
    order = np.argsort(value)
    value = value[order]
    same = np.zeros(len(value) + 1, bool)
    same[1:-1] = value[1:] == value[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    del value, order, same, at
    cover = np.zeros(len(words) + window + 1, np.int8)
    cover[twice] += 1
    cover[twice + window] -= 1
    repeated = np.cumsum(cover, dtype=np.int32)[: len(words)] > 0

    last = data[chunk.ends - 1] if len(chunk.ends) else np.empty(0, np.uint8)
    echo = np.zeros(len(words), bool)
    if len(words) > 1:
        echo[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    return {
        "n_words": chunk.n_words.astype(np.int64),
        "word_chars": per_row(point & chunk.solid, offsets),
        "n_symbols": per_row(SYMBOL[data], offsets),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": per_row(repeated, word_offsets),
        "n_chars": per_row(point, offsets),
        "n_lines": np.bincount(line_row, minlength=chunk.rows).astype(np.int64),
        "n_upper": per_row((data >= 65) & (data <= 90), offsets),
        "n_lower": per_row((data >= 97) & (data <= 122), offsets),
        "n_digits": per_row((data >= 48) & (data <= 57), offsets),
        "n_pipes": per_row(data == 124, offsets),
        "n_bangs": per_row(data == 33, offsets),
        "n_symbol_ends": per_row(SYMBOL[last], word_offsets),
        "n_bang_ends": per_row(last == 33, word_offsets),
        "n_echo": per_row(echo, word_offsets),
        "n_distinct": kinds(words, owner).astype(np.int64),
    }
