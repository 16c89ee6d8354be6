"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Piece lengths are integers of 1..capacity, so the whole decision depends only on
how many pieces have each length. The driver runs best-fit decreasing once over
that histogram: a segment tree over remaining capacities finds the tightest open
bin for a length in logarithmic time, and pieces of one length that meet equal
bins are placed together, exactly as one at a time would place them. The plan is
a bounded list of rank ranges; the executors turn the rank of a piece among the
pieces of its length into a sequence and an offset.

Null and empty texts give one piece that holds the end id alone. Repeated rows
are packed as often as they occur. An empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .bpe import id_bytes, load
from .groups import free_name
from .textkernel import chunks, small_batches

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked in one task; a length has as many parts as it takes.
RANK_ROWS = 1 << 20


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each text's ids and the end id: doc_id, piece, start, length and
    ``ids`` (little-endian unsigned 32-bit). Only longer documents are cut."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            doc_id = batch.column(0)
            for first, last, chunk in chunks(batch.column(1)):
                ids, offsets = bpe.encode(chunk)
                sizes = np.diff(offsets) + 1
                ids = np.insert(ids, offsets[1:], end_id)
                begin = np.append(0, np.cumsum(sizes))
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                cuts = np.append(begin[row] + start, begin[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id.slice(first, last - first).take(pa.array(row)),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        id_bytes(ids, cuts).cast(pa.binary()),
                    ],
                    names=schema.names,
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


class _Tree:
    """Segment tree over remaining capacities 0..capacity: how many runs of bins have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, at: int, n: int) -> None:
        at += self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` with a bin, or -1."""
        at = least + self.leaves
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length a list of (first rank, pieces a bin, first bin, offset):
    from that rank on, so many pieces at a time go to consecutive bins, the first
    of them at that offset. ``len`` of the bins is the last bin's number plus one."""
    tree = _Tree(capacity)
    runs: dict[int, deque[tuple[int, int]]] = {}  # remaining capacity: (first bin, bins)
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0

    def free(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, deque()).append((first, n))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        rows = out.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
                room = capacity
            else:
                each = room // length
                first, n = runs[room].popleft()
                tree.add(room, -1)
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            rows.append((rank, each, first, capacity - room))
            free(room - each * length, first, full)
            used = full
            if rest:
                free(room - rest * length, first + full, 1)
                used += 1
            if used < n:
                runs.setdefault(room, deque()).appendleft((first + used, n - used))
                tree.add(room, 1)
            rank += full * each + rest
            left -= full * each + rest
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with sequence_id
    and offset. Fewest bins that best-fit decreasing finds. Full pieces stand
    alone, in sequences numbered below zero, and aren't ranked; the others are
    ranked inside (length, part), so however many pieces have one length, a task
    ranks about ``rank_rows`` of them."""
    spark = pieces.sparkSession
    taken = set(pieces.columns)
    part, rank, parts = (free_name(n, taken) for n in ("part", "rank", "parts"))
    stored = materialize(pieces, "pieces")
    short = stored.where(F.col("length") < capacity)
    # one row for each length: at most capacity rows
    many = [(r["length"], -(-r["n"] // rank_rows)) for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()]
    several = spark.createDataFrame(many, f"length long, {parts} int")
    dealt = short.join(F.broadcast(several), "length").withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), parts).cast("int"))
    # one row for each length and part: capacity rows and one for each rank_rows pieces
    table = sorted((r["length"], r[part], r["n"]) for r in dealt.groupBy("length", part).agg(F.count("*").alias("n")).collect())
    histogram: dict[int, int] = {}
    start = {length: np.zeros(n, np.int64) for length, n in many}
    for length, p, n in table:
        start[length][p] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    scheme = plan(histogram, capacity)
    table_of = {n: np.array(scheme[n], np.int64) for n in sorted(scheme)}
    shared = spark.sparkContext.broadcast((start, table_of))

    order = Window.partitionBy("length", part).orderBy("doc_id", "piece")
    ranked = dealt.withColumn(rank, F.row_number().over(order))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keep = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, table_of = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            own_part, own_rank = batch.column(part).to_numpy(), batch.column(rank).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                n = int(length[own[0]])
                rows = table_of[n]
                row = start[n][own_part[own]] + own_rank[own] - 1
                use = rows[np.searchsorted(rows[:, 0], row, "right") - 1]
                ahead = row - use[:, 0]
                sequence[own] = use[:, 2] + ahead // use[:, 1]
                offset[own] = use[:, 3] + ahead % use[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    alone = stored.where(F.col("length") >= capacity)
    alone = alone.select(*keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.select(*keep, part, rank).mapInArrow(run, schema).unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, ids. A sequence holds
    at most ``capacity`` pieces, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return out.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_ids"), ids.alias("ids"))
