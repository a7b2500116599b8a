"""Best-fit packing with certified bin counts.

Documents are cut into pieces of at most one sequence.  Each partition packs its
pieces by best-fit decreasing and certifies the number of its bins by a lower
bound from dual feasible functions.  A partition that meets its bound is left alone; those
with a gap exchange the documents of their bins with room and run best-fit decreasing
again, until no gap is left or a round closes none.  At last the emptiest bin of each
partition may go: as the bound of a partition is rounded up, these bins can hold less
together than there are of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.bpe import encoded_texts
from fitforge.llm.scratch import cut

SEQUENCE_TOKENS = 2048
#: Pieces that one task packs; the number of partitions follows from it.
PIECES_PER_PARTITION = 20_000

_END = np.uint32(0)  # the id behind each document
_DUAL_STEPS = 64
_LAST_TURN = 2_000


def token_pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then id 0; null text counts as empty (one id).
    Documents longer than ``capacity`` are cut into pieces of ``capacity``, the
    first takes what is left over.  Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded_texts(batch.column(1), path), strict=True):
                ids = np.append(ids, _END)
                n = len(ids)
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length])))
                    start, piece = start + length, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin is.

    Longest first, each into the fullest bin that it fits.  Bins wait on a stack
    for each amount of room, and a bit of ``open_rooms`` says which stacks have any.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            waiting[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def bin_lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; ``counts[s]`` items have size s.

    The best of the bounds of three families of dual feasible functions: the size
    itself, the stepped functions u_k, and those that round large sizes up to a
    whole bin and drop small ones.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes].astype(object)
    best = -(-int((n * sizes).sum()) // capacity)
    for k in range(1, _DUAL_STEPS):
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, k * sizes, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    for small in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < small <= capacity // 2:
            value = np.where(sizes > capacity - small, capacity, np.where(sizes >= small, sizes, 0))
            best = max(best, -(-int((n * value).sum()) // capacity))
    return int(best)


def _packed(items: DataFrame, capacity: int, partitions: int, turn: int) -> DataFrame:
    """Pack in ``partitions`` groups; adds turn, pack_group, bin, offset, bin_fill, group_bins, group_bound."""
    kinds = {"turn": pa.int32(), **dict.fromkeys(("bin", "offset", "bin_fill", "group_bins", "group_bound"), pa.int64())}
    fields = [*items.dtypes, ("pack_group", "bigint"), *((k, "int" if k == "turn" else "bigint") for k in kinds)]

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = bin_lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        n = len(lengths)
        values = (np.full(n, turn), bins, offsets, fill[bins], np.full(n, len(fill)), np.full(n, bound))
        for (name, kind), column in zip(kinds.items(), values, strict=True):
            table = table.append_column(name, pa.array(column, kind))
        return table

    # dealt by row number, as repeated rows would meet in one group by their content
    dealt = items.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(partitions)))
    return dealt.groupBy("pack_group").applyInArrow(pack, ", ".join(f"{name} {kind}" for name, kind in fields))


_PARTITION = ["turn", "pack_group"]
_GAPPED, _CERTIFIED = "group_bins > group_bound", "group_bins = group_bound"


def _bins(packed: DataFrame) -> DataFrame:
    """The partitions: their bins, bound and pieces."""
    return packed.groupBy(*_PARTITION).agg(F.max("group_bins").alias("group_bins"), F.max("group_bound").alias("group_bound"), F.sum("length").alias("tokens"))


def _exchanged(packed: DataFrame, capacity: int, pieces_per_partition: int, columns: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Exchange between partitions with a gap until none closes: the packings that stay, and the last one."""
    done: list[DataFrame] = []
    for turn in count(1):
        partitions = _bins(packed)
        gapped = partitions.where(_GAPPED).select(*_PARTITION)
        n_gapped = gapped.count()
        if not n_gapped:
            return done, packed
        reopened = packed.where(_GAPPED)
        if n_gapped == 1:  # a partner to exchange with: the certified partition with most room
            room = F.col("group_bins") * capacity - F.col("tokens")
            partner = partitions.where(_CERTIFIED).orderBy(room.desc(), *_PARTITION).first()
            if partner is None:
                return done, packed
            is_partner = (F.col("turn") == partner["turn"]) & (F.col("pack_group") == partner["pack_group"])
            reopened, untouched = packed.where(F.expr(_GAPPED) | is_partner), packed.where(F.expr(_CERTIFIED) & ~is_partner)
        else:
            untouched = packed.where(_CERTIFIED)
        loose = reopened.where(F.col("bin_fill") < capacity)
        before = loose.agg(F.count("*").alias("n"), F.countDistinct(*_PARTITION, "bin").alias("bins")).first()
        new = cut(_packed(loose.select(*columns), capacity, max(1, -(-before["n"] // pieces_per_partition)), turn), f"packed_{turn}")
        if (_bins(new).agg(F.sum("group_bins")).first()[0] or 0) >= before["bins"]:
            return done, packed
        done += [untouched, reopened.where(F.col("bin_fill") == capacity)]
        packed = new
    raise AssertionError("count() does not end")


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, pieces_per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; ``pieces`` is read several times.

    Pieces must have a length from 1 to ``capacity``; other columns stay.  Those that
    fill a sequence have it to themselves.  ``certified`` says whether the bins of
    the partition that packed the piece last are proven to be the fewest for its
    pieces.  No pieces give no rows.
    """
    whole = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row for each length
        counts[r["length"]] = r["n"]
    partitions = max(1, -(-int(counts.sum()) // pieces_per_partition))
    first = cut(_packed(rest, capacity, partitions, 0), "packed_0")
    done, last = _exchanged(first, capacity, pieces_per_partition, pieces.columns)
    packed = reduce(DataFrame.unionByName, [*done, last])
    packed = _without_emptiest(packed, capacity, pieces_per_partition, bin_lower_bound(counts, capacity), pieces.columns)
    # turn, group and bin in one number; sequences of their own are numbered below zero
    number = F.shiftleft(F.col("turn").cast("long"), 52) + F.shiftleft(F.col("pack_group"), 24) + F.col("bin")
    held = packed.select(*pieces.columns, number.alias("sequence_id"), "offset", F.expr(_CERTIFIED).alias("certified"))
    return held.unionByName(whole.select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")))


def _without_emptiest(packed: DataFrame, capacity: int, pieces_per_partition: int, least: int, columns: list[str]) -> DataFrame:
    """The packing with the emptiest bins of the partitions packed together, where that takes fewer bins."""
    bins = packed.groupBy(*_PARTITION, "bin").agg(F.first("bin_fill").alias("fill"), F.count("*").alias("n"))
    emptiest = bins.groupBy(*_PARTITION).agg(F.min(F.struct("fill", "bin", "n")).alias("e")).where(F.col("e.fill") < capacity)
    emptiest = cut(emptiest.select(*_PARTITION, "e.bin", "e.n"), "emptiest")
    found = emptiest.agg(F.count("*").alias("bins"), F.sum("n").alias("n")).first()
    if found["bins"] < 2 or bins.count() <= least:
        return packed
    pooled = packed.join(emptiest.drop("n"), [*_PARTITION, "bin"], "left_semi").select(*columns)
    new = cut(_packed(pooled, capacity, max(1, -(-found["n"] // pieces_per_partition)), _LAST_TURN), "packed_last")
    if (_bins(new).agg(F.sum("group_bins")).first()[0] or 0) >= found["bins"]:
        return packed
    return packed.join(emptiest.drop("n"), [*_PARTITION, "bin"], "left_anti").unionByName(new)


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, **limits: int) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and
    certified, one row per piece.  Null texts count as empty, a null doc_id is packed
    like any other, very long texts give as many pieces as it takes; repeated rows are
    packed as often as they come; other columns are left out; an empty table gives no rows.
    """
    return pack_pieces(cut(token_pieces(docs, path, capacity), "pieces"), capacity, **limits)
