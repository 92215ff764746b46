"""Best-fit packing of documents into bins of fixed capacity by hierarchical residual merging.

Documents become items of at most ``capacity`` tokens (runs of non-space characters): a longer one is cut into
full pieces and a rest.  Every partition packs its items best-fit decreasing and emits the bins that are nearly
full.  An underfull bin becomes an item of the next round, in which FAN partitions are merged into one; rounds go
on until a single partition has packed what is left.  Best-fit leaves at most one bin that is no more than half full, and
two that are more than half full never fit together.  So a merge of FAN partitions has at most FAN small items to place, and a
partition that hands on its small bin and its FAN roomiest others hands on all that can matter; the rest is emitted too.  What a
merging task gets is bounded by FAN, whatever the input.  Only ids and lengths move, never text.

The packing depends on how the table is split into partitions; the same files under the same settings give the same bins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow

#: Tokens of a bin; fill from which a bin is emitted at once; partitions merged into one by a round.
CAPACITY, FULL, FAN = 2048, 0.98, 16
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64())])
PACKED = pa.schema([("bin", pa.string()), ("fill", pa.int64()), ("done", pa.bool_()), ("members", pa.list_(MEMBER))])
PACKED_DDL = "bin string, fill bigint, done boolean, members array<struct<doc_id:bigint,piece:bigint,start:bigint,tokens:bigint>>"


def tokens(text: Column) -> Column:
    """Runs of non-space characters; none in a null text."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+")).cast("bigint")


def best_fit(items: list[tuple[int, tuple, list]], capacity: int) -> list[tuple[int, list[tuple[tuple, list]]]]:
    """Bins (fill, [(key, members)]) of items (size, key, members): best-fit decreasing, ties by key."""
    bins: list[list] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for size, key, members in sorted(items, key=lambda x: (-x[0], x[1])):
        i = bisect.bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(i)
        else:
            room, at = capacity, len(bins)
            bins.append([0, []])
        bins[at][0] += size
        bins[at][1].append((key, members))
        if room := room - size:
            if room not in open_by_room:
                open_by_room[room] = []
                bisect.insort(rooms, room)
            open_by_room[room].append(at)
    return bins


def carried(bins: list[tuple[int, list]], capacity: int, full: int, fan: int) -> set[int]:
    """Which of the bins of a task go on to the next round: of those under ``full`` all that are at most half full and the ``fan`` roomiest others."""
    under = [i for i, b in enumerate(bins) if b[0] < full]
    small = [i for i in under if 2 * bins[i][0] <= capacity]
    return {*small, *sorted((i for i in under if 2 * bins[i][0] > capacity), key=lambda i: (bins[i][0], i))[:fan]}


def _rows(bins: list, on: set[int], tag: str) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(bins), 4096):
        part = bins[lo : lo + 4096]
        yield pa.RecordBatch.from_pylist([{"bin": f"{tag}-{lo + k}", "fill": fill, "done": lo + k not in on, "members": [m for _, ms in inner for m in ms]} for k, (fill, inner) in enumerate(part)], schema=PACKED)


def packed(docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, fan: int = FAN) -> DataFrame:
    """(bin_id, bin_tokens, position, doc_id, piece, first_token, tokens): the place of every piece of every document.

    Pieces are numbered from 0, first_token is a piece's offset in its document.  A document without tokens (empty,
    blank or null) has no piece.  Rows that repeat a doc_id are packed each; a null doc_id stays null.  Items of equal
    length are taken by doc_id and piece.  A text of any length is only counted, by the JVM.  An empty table gives no bins; other
    columns are not looked at, so their names can't clash."""
    least = int(-(-capacity * full // 1))
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens(F.col("text")).alias("n")).filter("n > 0")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, pid = [], TaskContext.get().partitionId()
        for batch in batches:
            for d, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    items.append((size, (d is None, d or 0, piece), [{"doc_id": d, "piece": piece, "start": at, "tokens": size}]))
        bins = best_fit(items, capacity)
        yield from _rows(bins, carried(bins, capacity, least, fan), f"0-{pid}")

    def merge(last: bool, level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, pid = [], TaskContext.get().partitionId()
            for batch in batches:
                for r in batch.to_pylist():
                    m = r["members"][0]
                    items.append((r["fill"], (m["doc_id"] is None, m["doc_id"] or 0, m["piece"], r["bin"]), r["members"]))
            bins = best_fit(items, capacity)
            yield from _rows(bins, set() if last else carried(bins, capacity, least, fan), f"{level}-{pid}")

        return run

    level, table = 0, Shared(arrow(cut, first, PACKED_DDL))
    out = table.df.filter("done")
    parts = max(1, cut.rdd.getNumPartitions())
    while True:
        level, parts = level + 1, -(-parts // fan)
        rest = table.df.filter("not done").repartition(parts, "bin")
        table = Shared(arrow(rest, merge(parts == 1, level), PACKED_DDL))
        out = out.unionByName(table.df.filter("done"))
        if parts == 1:
            break
    return out.select(F.col("bin").alias("bin_id"), F.col("fill").alias("bin_tokens"), F.posexplode("members").alias("position", "m")).select("bin_id", "bin_tokens", "position", "m.doc_id", "m.piece", F.col("m.start").alias("first_token"), "m.tokens")
