"""Best-fit packing of token sequences by bin completion.

Texts become pieces of at most `capacity` ids. Only the counts of piece lengths go to the driver (at most `capacity` rows).
Bin completion plans on these counts: around the largest open length it enumerates undominated fillings of the remaining
room, least waste first, and branches over them, pruning by the waste that any better packing may still have; best-fit
decreasing gives the first incumbent. A pattern is laid down as often as its lengths last, so the plan's size
depends on the capacity and not on the data. Pieces then find their places by their rank among pieces of their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roiforge.llm.common import partitions, sliced, stored, text_or_empty, token_bytes, tokenizer_path, with_fields

#: Fillings enumerated at a node, nodes of the search, items of a filling beside the largest: limits of the search, not of the data.
FILLINGS, NODES, FILLERS = 4, 4_000, 4


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counted lengths: patterns (lengths, times).

    Each piece, the longest first, goes to the open bin with the least room that still holds it. Bins with the same content are counted
    together, so the work follows from the number of lengths and of different contents, not of pieces.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # open bins by their room
    order: list[int] = []  # rooms, ascending

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((pattern, times))

    def take(room: int) -> tuple[tuple[int, ...], int]:
        found = rooms[room].pop()
        if not rooms[room]:
            del rooms[room]
            order.pop(bisect.bisect_left(order, room))
        return found

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(order, s)
            if at < len(order):
                room = order[at]
                pattern, times = take(room)
                # a bin just served has the least room of those like it, so it is filled first
                each = min(room // s, n)
                served = min(times, n // each)
                if times > served:
                    put(room, pattern, times - served)
                put(room - each * s, pattern + (s,) * each, served)
                n -= each * served
            else:
                each = min(capacity // s, n)
                put(capacity - each * s, (s,) * each, n // each)
                n -= each * (n // each)
    return [bins for room in order for bins in rooms[room]]


def fillings(room: int, sizes: list[int], left: dict[int, int], most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of room from descending sizes, least waste first.

    Left out are fillings to which an open length could still be added, and those in which a length could grow to an open
    one that still fits, or two be replaced by one of at least their sum: the other filling dominates them.
    """
    present = np.zeros(room + 1, dtype=bool)
    fitting = [s for s in sizes if s <= room]
    present[fitting] = True
    if not fitting:
        return [()]
    #: largest open length at most r
    floor = np.maximum.accumulate(np.where(present, np.arange(room + 1), 0))
    found: dict[tuple[int, ...], int] = {}

    def grow(chosen: tuple[int, ...], rest: int, start: int, depth: int) -> None:
        if len(found) >= 8 * most:
            return
        if depth == 0 or rest == 0 or not floor[rest]:
            found[chosen] = rest
            return
        top = min(int(floor[rest]), start)
        tried = 0
        while top > 0 and tried < most:
            if left[top] > chosen.count(top):
                grow((*chosen, top), rest - top, top, depth - 1)
                tried += 1
            top = int(floor[top - 1])
        if not tried:
            found[chosen] = rest

    # single lengths and pairs that leave nothing open, before the general search: all of them are looked at, the first `most` kept
    if present[room]:
        found[(room,)] = 0
    firsts = np.arange(room - 1, (room + 1) // 2 - 1, -1)
    for s in firsts[present[firsts] & present[room - firsts]].tolist() if room > 1 else []:
        if len(found) >= most:
            break
        if left[room - s] > (room - s == s):
            found[(s, room - s)] = 0
    if len(found) < most:
        grow((), room, room, FILLERS)

    def dominated(f: tuple[int, ...], waste: int) -> bool:
        for k, s in enumerate(f):
            bigger = int(floor[min(room, s + waste)])
            if bigger > s and left[bigger] > f.count(bigger):
                return True
            for t in f[k + 1 :]:
                joint = int(floor[min(room, s + t + waste)])
                if joint >= s + t and waste and left[joint] > f.count(joint):
                    return True
        return bool(waste and floor[waste] and left[int(floor[waste])] > f.count(int(floor[waste])))

    ranked = sorted(found.items(), key=lambda x: (x[1], len(x[0]), tuple(-s for s in x[0])))
    return ([f for f, w in ranked if not dominated(f, w)] or [f for f, _ in ranked])[:most]


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use every counted length, in as few bins as the search finds.

    Depth first over fillings around the largest open length. A branch is cut when its waste so far leaves no room for
    fewer bins than the incumbent's; the search ends when the incumbent meets the bound of total length over capacity.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a length is not in 1..capacity")
    best = best_fit(counts, capacity)
    bins = lambda patterns: sum(t for _, t in patterns)
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)
    left, budget = dict(counts), [nodes]
    stack: list[tuple[tuple[int, ...], int, int]] = []  # pattern, times, waste so far

    def options(waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        top = sizes[0]
        left[top] -= 1
        choice = fillings(capacity - top, [s for s in sizes if left[s]], left)
        left[top] += 1
        for f in choice:
            pattern = (top, *f)
            spare = capacity - sum(pattern)
            times = min(left[s] // pattern.count(s) for s in set(pattern))
            if spare:  # only as often as the incumbent still allows, but once at least
                times = max(1, min(times, (bins(best) * capacity - total - waste) // spare))
            # as often as it can be laid down, and on coming back half as often, down to once
            while times:
                yield pattern, times
                times //= 2

    levels = [options(0)] if counts else []
    while levels and bins(best) > bound and budget[0] > 0:
        waste = stack[-1][2] if stack else 0
        step = next(levels[-1], None)
        if step is None:
            levels.pop()
            if stack:
                pattern, times, _ = stack.pop()
                for s in pattern:
                    left[s] += times
            continue
        budget[0] -= 1
        pattern, times = step
        waste += times * (capacity - sum(pattern))
        if -(-(total + waste) // capacity) >= bins(best):
            continue  # no fewer bins than the incumbent
        for s in pattern:
            left[s] -= times
        stack.append((pattern, times, waste))
        if any(left.values()):
            levels.append(options(waste))
        else:
            best = [(p, t) for p, t, _ in stack]
            pattern, times, _ = stack.pop()
            for s in pattern:
                left[s] += times
    return best


def cut_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents, stored: doc_id, row (tells repeated rows apart), piece int, start long, length long, ids binary.

    ids are little-endian unsigned 32-bit, with end_id after each document. A null or empty text is the end id alone.
    Texts longer than capacity are cut into pieces of that length and a shorter last one. Other columns are ignored.
    """
    vocabulary = tokenizer or tokenizer_path()
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(i, r, k // step, k // 4, x[k : k + step]) for i, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x + end for x in token_bytes(b.column(2).to_pylist(), vocabulary)), strict=True) for k in range(0, len(x), step)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [len(r[4]) // 4 for r in rows], [r[4] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids binary"), "pieces")


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on a slot serves, the first sequence of its pattern, how many of the length it has, and where the first of these lies."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            slots.setdefault(s, []).append((rank.get(s, 0), sequence, k, offset))
            rank[s] = rank.get(s, 0) + k * times
            offset += k * s
        sequence += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for s, rows in slots.items()}


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (length and other columns; doc_id, row and piece tell rows apart) with sequence_id and offset.

    Ranks within a length: pieces are dealt to buckets by hash, counted (at most 4 for each partition, and one for each
    length, on the driver), and numbered within their bucket, so that a length which a third of all pieces share is spread.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    total, spread = sum(counts.values()), 4 * partitions(spark)
    slots = places(complete_bins(counts, capacity))
    buckets = F.broadcast(spark.createDataFrame([(s, max(1, n * spread // total)) for s, n in counts.items()], "length long, buckets long"))
    dealt = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.col("buckets"))).drop("buckets")
    first, sofar = {}, dict.fromkeys(counts, 0)
    for r in sorted(dealt.groupBy("length", "bucket").count().collect(), key=lambda r: (r["length"], r["bucket"])):
        first[r["length"], r["bucket"]] = sofar[r["length"]]
        sofar[r["length"]] += r["count"]
    at = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")) - 1
    ranked = dealt.withColumn("rank", at.cast("long"))
    names, kept = ranked.columns, pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, bucket, rank = (b.column(names.index(x)).to_numpy() for x in ("length", "bucket", "rank"))
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for s in np.unique(lengths):
                mine = np.flatnonzero(lengths == s)
                since, base, k, start = slots[int(s)]
                r = rank[mine] + np.array([first[int(s), int(x)] for x in bucket[mine]], dtype=np.int64)
                slot = np.searchsorted(since, r, side="right") - 1
                inside = r - since[slot]
                sequence[mine] = base[slot] + inside // k[slot]
                offset[mine] = start[slot] + inside % k[slot] * s
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(x)) for x in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, with_fields(pieces, "sequence_id long, offset long"))


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, where each lies): the second has doc_id, row, piece, start, length, ids_crc32, sequence_id, offset.

    sequences() joins both. An empty table gives two empty ones. Repeated rows are packed as often as they occur.
    """
    pieces = cut_documents(docs, capacity, end_id, tokenizer)
    slim = pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces, assign(slim, capacity)


def placed_pieces(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a piece: sequence_id, offset, doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    both = pieces.select("doc_id", "row", "piece", "start", "length", "ids").join(placed.select("row", "piece", "sequence_id", "offset"), ["row", "piece"])
    return both.select("sequence_id", "offset", "doc_id", "piece", "start", "length", "ids")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """Packed sequences: sequence_id, ids (binary, little-endian unsigned 32-bit), n_ids, and of each piece in it doc_ids, pieces and offsets.

    At most capacity pieces meet in a row.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    grouped = placed_pieces(pieces, placed).groupBy("sequence_id").agg(parts.alias("p"))
    named = [F.col(f"p.{c}").alias(n) for c, n in (("doc_id", "doc_ids"), ("piece", "pieces"), ("offset", "offsets"))]
    return grouped.select("sequence_id", ids.alias("ids"), *named).withColumn("n_ids", (F.length("ids") / 4).cast("int"))
