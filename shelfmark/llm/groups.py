"""Groups of any size, dealt out as pairs of bounded pages.

A group's rows are hashed to pages of a bounded weight; every pair of pages
(p, q), p <= q, is one unit of work. A small group is the single unit (0, 0). No
unit holds more than two pages however large its group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A written table is broadcast if it is counted to have so few rows, and joined by shuffling beyond.
FEW = 50_000


def few(table: DataFrame, most: int = FEW) -> DataFrame:
    """``table`` (written before), to be broadcast if its rows are counted few."""
    return F.broadcast(table) if table.count() <= most else table


def free_name(name: str, taken: set[str] | list[str]) -> str:
    """``name``, with underscores until ``taken`` doesn't hold it."""
    while name in taken:
        name += "_"
    return name


def large(members: DataFrame, group: str, weight: str, page_rows: int, page_weight: int) -> DataFrame:
    """(group, pages) of the groups that don't fit in one page. Only these are
    looked up by group, broadcast while they are few; there is one of them for
    every ``page_rows`` rows at most."""
    size = members.groupBy(group).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    pages = F.greatest(F.ceil(F.col("_n") / page_rows), F.ceil(F.col("_w") / page_weight)).cast("int")
    return size.select(group, pages.alias("pages")).where("pages > 1")


def page_of(item: str | Column, pages: str | Column = "pages") -> Column:
    return F.pmod(F.xxhash64(item), F.col(pages) if isinstance(pages, str) else pages).cast("int")


def page_pairs(page: str = "page", pages: str = "pages") -> Column:
    """All units of a row: an array of (p, q) with its page as one of the two."""
    return F.transform(F.sequence(F.lit(0), F.col(pages) - 1), lambda q: F.struct(F.least(page, q).alias("p"), F.greatest(page, q).alias("q")))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each run of rows with equal ``keys`` (sorted or at
    least adjacent) lies in one batch; a batch holds many small runs."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if last is not None and last != tuple(c[0] for c in columns):
            yield _joined(held)
            held = []
        edges = np.flatnonzero(change)
        if len(edges):
            held.append(batch.slice(0, int(edges[-1])))
            yield _joined(held)
            held = [batch.slice(int(edges[-1]))]
        else:
            held.append(batch)
        last = tuple(c[-1] for c in columns)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def bounds(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """The (first, end) rows of each run of equal ``keys`` in ``batch``."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        change[1:] |= c[1:] != c[:-1]
    edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    return list(zip(edges[:-1], edges[1:]))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the least item that it reaches over (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of ``n`` linked items to the smallest id that it reaches
    over the links (a, b): a spanning forest of what the links connect."""
    ids = ids.astype(np.int64)
    label = labels(n, a, b)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    out = np.flatnonzero(least[label] != ids)
    return ids[out], least[label][out]
