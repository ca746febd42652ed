"""Prefix tries of conversations, as succinct level-order tries by prefix shard.

A conversation is its sequence of turns, a turn a digest of role and text. Different sequences are sorted and cut into shards of about
equal size, so a shard holds neighbouring prefixes whatever their weight. In a shard numpy lays the trie out level by level: a LOUDS
bitvector (a one for each child and a zero for each node), labels and sizes in the same order. Sums over subtrees go from the last level to
the first with add.at. Only prefixes of a shard's first and last sequence can lie in other shards too: these heavy upper nodes are
written apart, merged over shards in tiers, and rolled up by themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiforge.llm.common import partitions, stored

#: Turns of a shard (about), shards whose upper nodes meet in one task, conversation ids in a piece of a list.
SHARD_TURNS, FAN, PIECE = 100_000, 1000, 500
#: Bytes of a turn's digest: the first half of a SHA-256.
WIDTH = 16
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values are all of one width, as a matrix of bytes."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]].reshape(-1, width)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _by_group(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by a column, cut and joined so that equal values stand in one batch."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(column).to_numpy()
        cut = int(np.argmax(at == at[-1]))
        if kept and (cut or kept[-1].column(column)[0].as_py() != at[0]):
            yield _joined([*kept, b.slice(0, cut)])
            kept = []
        elif cut:
            yield b.slice(0, cut)
        kept.append(b.slice(cut))
    if kept:
        yield _joined(kept)


# --- sequences -------------------------------------------------------------------------------------------------------


def _branched(base: np.ndarray, conv: np.ndarray, branching: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and the turns (row numbers) of rebuilt conversations; rows are sorted by base, its own conversation first."""
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    ids, mine, n = conv[first], base[first], np.diff(np.append(first, len(conv)))
    h = np.array([zlib.crc32(b"%d" % c) % branching for c in ids.tolist()], dtype=np.int64) if branching else np.zeros(len(ids), dtype=np.int64)
    groups = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    lead = groups[np.searchsorted(groups, np.arange(len(ids)), side="right") - 1]
    head = np.where(ids[lead] == mine[lead], np.minimum(h, n[lead]), 0)
    tail = np.maximum(n - h, 0)
    begins, lengths = np.stack([first[lead], first + h], axis=1).ravel(), np.stack([head, tail], axis=1).ravel()
    ends = np.cumsum(lengths)
    return ids, head + tail, np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])


def sequences(turns: DataFrame, branching: int | None = None, block: int = 100) -> DataFrame:
    """conv_id, path and sizes: a conversation's turns as digests of 16 bytes one after the other, and their numbers of code points (4 bytes each).

    Turns are ordered by turn, nulls first, and equal ones by digest; null roles and texts count as empty; rows without conv_id have no
    conversation. With branching=m the first h turns are those of conversation c - c % block instead, h being the CRC-32 of c in decimal
    modulo m (all of them if it has fewer, none if it doesn't exist). Texts are hashed where they are read; what moves is 40 bytes a turn. A
    conversation, and with branching a block, is gathered in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDTH)
    conv = F.col("conv_id").cast("long")
    base = conv - conv % block if branching else conv
    rows = turns.where("conv_id is not null").select(base.alias("base"), conv.alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("label"), F.length(text).alias("size"))
    ordered = rows.repartition("base").sortWithinPartitions("base", F.col("base") != F.col("conv"), "conv", F.col("turn").asc_nulls_first(), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_group(batches, 0):
            ids, lengths, at = _branched(b.column(0).to_numpy(), b.column(1).to_numpy(), branching)
            labels, sizes = _bytes(b.column(3), WIDTH)[at], b.column(4).to_numpy()[at].astype("<i4")
            ends = np.concatenate([[0], np.cumsum(lengths)])
            packed = [pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))]) for v, w in ((labels, WIDTH), (sizes, 4))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *packed], names=["conv_id", "path", "sizes"])

    return ordered.mapInArrow(run, "conv_id long, path binary, sizes binary")


def _digest_of(path: str) -> Column:
    return F.substring(F.unhex(F.sha2(path, 256)), 1, WIDTH)


def sequence_members(found: DataFrame) -> DataFrame:
    """conv_id (the smallest), n and ends (SHA-256 of the members' ids, ascending and comma-joined) of each different sequence.

    Sorted by range, so that members of one sequence may lie in many tasks, and joined to pieces of 500 ids; a sequence's pieces are then hashed
    as a stream, as SHA-256 must be: 1/500 of a group's rows reach one task.
    """
    spread = found.select(_digest_of("path").alias("key"), "conv_id").repartitionByRange(partitions(found.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, ids = _bytes(b.column(0), WIDTH), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(ids)]
            starts = [s for a, e in zip(edges, edges[1:], strict=False) for s in range(a, e, PIECE)]
            words = ids.astype(str)
            spans = list(zip(starts, [*starts[1:], len(ids)], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(starts)), pa.array(ids[starts]), pa.array([e - s for s, e in spans], pa.int64()), pa.array([",".join(words[s:e]) for s, e in spans], pa.string())], names=["key", "first", "n", "listed"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, []
        schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.binary())])
        for b in batches:
            for key, first, n, listed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != key:
                    told += [(now[1], now[2], now[3].digest())] if now else []
                    now = [key, first, 0, hashlib.sha256()]
                now[3].update((("," if now[2] else "") + listed).encode())
                now[2] += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), schema, strict=True)] if told else [pa.array([], f.type) for f in schema], schema=schema)
            told = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now[1], now[2], now[3].digest()), schema, strict=True)], schema=schema)

    parts = spread.mapInArrow(pieces, "key binary, first long, n long, listed string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "conv_id long, n long, ends binary")


# --- tries -----------------------------------------------------------------------------------------------------------


@dataclass
class Trie:
    """A level-order trie. bits: 10 for a node above the root, then for each node a one for each child and a zero. labels and sizes follow the
    nodes; the root has none. Of the nodes where sequences end: their numbers, members, smallest member and digest of the members."""

    bits: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    end_nodes: np.ndarray
    end_n: np.ndarray
    end_conv: np.ndarray
    end_digests: np.ndarray

    FIELDS = (("bits", np.uint8), ("labels", np.uint8), ("sizes", np.int32), ("end_nodes", np.int32), ("end_n", np.int64), ("end_conv", np.int64), ("end_digests", np.uint8))

    @classmethod
    def of(cls, labels: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, n: np.ndarray, conv: np.ndarray, digests: np.ndarray) -> Trie:
        """From different sequences in ascending order: their labels and sizes one after the other, and each one's length, members and so on."""
        m = len(lengths)
        first = np.concatenate([[0], np.cumsum(lengths)])
        # how far each sequence agrees with the one before it
        common = np.concatenate([[0], np.minimum(lengths[1:], lengths[:-1])])
        pair = np.repeat(np.arange(m), common)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(common) - common, common)
        differ = (labels[first[pair] + place] != labels[first[pair - 1] + place]).any(1)
        np.minimum.at(common, pair[differ], place[differ])
        # a node for each place beyond that; ordered by depth, then by sequence
        own = np.repeat(np.arange(m), lengths)
        depth = np.arange(len(own)) - first[own] + 1
        new = np.flatnonzero(depth > common[own])
        new = new[np.argsort(depth[new], kind="stable")]
        rank = np.concatenate([[0], depth[new] * m + own[new]])
        parent = np.searchsorted(rank, rank[1:] - m, side="right") - 1
        degree = np.bincount(parent, minlength=len(rank))
        bits = np.ones(2 * len(rank) + 1, dtype=np.uint8)
        bits[1], bits[2 + np.cumsum(degree + 1) - 1] = 0, 0
        return cls(np.packbits(bits), labels[new], np.concatenate([[0], sizes[new]]).astype(np.int32), np.searchsorted(rank, np.where(lengths > 0, lengths * m + np.arange(m), 0)).astype(np.int32), n, conv, digests)

    def __len__(self) -> int:
        return len(self.sizes)

    @cached_property
    def parents(self) -> np.ndarray:
        """The node j is the j-th one of the bitvector; the zeros before it, less that of the node above the root, number its parent. The root's is -1."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * len(self) + 1))
        return ones - np.arange(len(self)) - 1

    @cached_property
    def degrees(self) -> np.ndarray:
        return np.bincount(self.parents[1:], minlength=len(self))

    @cached_property
    def levels(self) -> list[tuple[int, int]]:
        """Each level's first node and the one after its last."""
        found, below = [(0, 1)], np.concatenate([[0], np.cumsum(self.degrees)])
        while found[-1][0] < found[-1][1]:
            a, b = found[-1]
            found.append((b, b + int(below[b] - below[a])))
        return found[:-1]

    def child(self, node: int, label: bytes) -> int:
        """The child of a node with a label, or -1."""
        a = 1 + int(self.degrees[:node].sum())
        near = np.flatnonzero((self.labels[a - 1 : a - 1 + self.degrees[node]] == np.frombuffer(label, dtype=np.uint8)).all(1))
        return a + int(near[0]) if len(near) else -1

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of members and smallest member of every node."""
        n, conv = np.zeros(len(self), dtype=np.int64), np.full(len(self), np.iinfo(np.int64).max)
        n[self.end_nodes], conv[self.end_nodes] = self.end_n, self.end_conv
        for a, b in self.levels[:0:-1]:
            np.add.at(n, self.parents[a:b], n[a:b])
            np.minimum.at(conv, self.parents[a:b], conv[a:b])
        return n, conv

    def edges(self) -> tuple[list[int], list[int]]:
        """Nodes that other shards may hold too: the first, and the last, of each level as long as the parent is one of them."""
        sides: tuple[list[int], list[int]] = ([0], [0])
        for side, which in zip(sides, (lambda a, b: a, lambda a, b: b - 1), strict=True):
            for a, b in self.levels[1:]:
                if self.parents[which(a, b)] != side[-1]:
                    break
                side.append(which(a, b))
        return sides

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f), dtype=k).tobytes() for f, k in self.FIELDS]

    @classmethod
    def from_row(cls, row: list[bytes]) -> Trie:
        values = [np.frombuffer(v, dtype=k) for v, (_, k) in zip(row, cls.FIELDS, strict=True)]
        values[1], values[6] = values[1].reshape(-1, WIDTH), values[6].reshape(-1, 32)
        return cls(*values)


def rolled_up(levels: list[np.ndarray], parents: np.ndarray, shut: np.ndarray, n: np.ndarray, sizes: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
    """Adds up children, leaves and saved code points, last level first, in place. Only nodes that are shut count for themselves and pass on to their parents."""
    for level in reversed(levels):
        at = level[shut[level]]
        leaves[at] += children[at] == 0
        saved[at] += (n[at] - 1) * sizes[at]
        at = at[parents[at] >= 0]
        for v, x in ((children, 1), (leaves, leaves[at]), (saved, saved[at])):
            np.add.at(v, parents[at], x)


_TRIE = "shard int, " + ", ".join(f"{f} binary" for f, _ in Trie.FIELDS)
_EDGE = "shard int, node int, key binary, above binary, depth int, first boolean, last boolean, n long, conv long, children long, leaves long, saved long, size long, ends binary"
_EDGE_TYPES = [{"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}[f.split()[1]] for f in _EDGE.split(", ")]
_EDGE_NAMES = [f.split()[0] for f in _EDGE.split(", ")]


def shards(found: DataFrame, members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Tries of neighbouring sequences (shard and the trie's arrays as bytes), all different sequences once. found: sequences(); members: sequence_members()."""
    distinct = stored(found.join(members, "conv_id"), "distinct-sequences")
    total = distinct.agg(F.sum(F.length("path") / WIDTH)).first()[0] or 0
    ordered = distinct.select("path", "sizes", "n", "conv_id", "ends").repartitionByRange(max(1, int(total // shard_turns) + 1), "path").sortWithinPartitions("path")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        paths, sizes, ends = (b"".join(x for b in parts for x in b.column(k).to_pylist()) for k in (0, 1, 4))
        lengths = np.array([len(x) // WIDTH for b in parts for x in b.column(0).to_pylist()], dtype=np.int64)
        n, conv = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (2, 3))
        trie = Trie.of(np.frombuffer(paths, dtype=np.uint8).reshape(-1, WIDTH), lengths, np.frombuffer(sizes, dtype="<i4"), n, conv, np.frombuffer(ends, dtype=np.uint8).reshape(-1, 32))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([v], pa.binary()) for v in trie.row())], names=[f.split()[0] for f in _TRIE.split(", ")])

    return stored(ordered.mapInArrow(build, _TRIE), "tries")


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Trie, list]]:
    """(shard, trie, further columns' values) of each row."""
    k = len(Trie.FIELDS) + 1
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), Trie.from_row([b.column(c)[i].as_py() for c in range(1, k)]), [b.column(c)[i].as_py() for c in range(k, b.num_columns)]


def _summed(trie: Trie) -> tuple[np.ndarray, ...]:
    """open nodes, n, conv, children, leaves, saved of a shard's trie; open nodes count only what hangs below them and is shut."""
    n, conv = trie.members()
    shut = np.ones(len(trie), dtype=bool)
    shut[[x for side in trie.edges() for x in side]] = False
    children, leaves, saved = (np.zeros(len(trie), dtype=np.int64) for _ in range(3))
    rolled_up([np.arange(a, b) for a, b in trie.levels], trie.parents, shut, n, trie.sizes.astype(np.int64), children, leaves, saved)
    return shut, n, conv, children, leaves, saved


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, trie, _ in _tries(batches):
        _, n, conv, children, leaves, saved = _summed(trie)
        ended = {int(x): trie.end_digests[k].tobytes() for k, x in enumerate(trie.end_nodes)}
        rows: dict[int, list] = {}
        for which, side in enumerate(trie.edges()):
            h, above = hashlib.sha256(), None
            for depth, node in enumerate(side):
                if node:
                    h.update(trie.labels[node - 1].tobytes())
                key = h.copy().digest()[:WIDTH]
                row = rows.setdefault(node, [shard, node, key, above, depth, False, False, *(int(v[node]) for v in (n, conv, children, leaves, saved, trie.sizes)), ended.get(node)])
                row[5 + which], above = True, key
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows.values(), strict=True), _EDGE_TYPES, strict=True)], names=_EDGE_NAMES)


def _merged(table: pa.Table, fan: int, last_tier: bool) -> pa.Table:
    """Upper nodes of neighbouring shards, equal ones merged. Those that still may lie elsewhere keep first or last set; the others are done, node being -1."""
    c = {name: table.column(name).combine_chunks() for name in _EDGE_NAMES}
    keys = np.array([x + b"\1" for x in c["key"].to_pylist()], dtype=f"S{WIDTH + 1}")
    known, one, at = np.unique(keys, return_index=True, return_inverse=True)
    shard = c["shard"].to_numpy()
    some = lambda name, fold, start: _folded(c[name].to_numpy(), at, len(known), fold, start)
    n, children, leaves, saved = (some(k, np.add, 0) for k in ("n", "children", "leaves", "saved"))
    conv = some("conv", np.minimum, np.iinfo(np.int64).max)
    sides = []
    for name, outer in (("first", shard.min()), ("last", shard.max())):
        mine = c[name].to_numpy(zero_copy_only=False) & (shard == outer)
        sides.append(np.zeros(len(known), dtype=bool) if last_tier else np.bincount(at, mine, minlength=len(known)) > 0)
    depth, size = c["depth"].to_numpy()[one], c["size"].to_numpy()[one]
    above = [c["above"][int(i)].as_py() for i in one]
    parents = np.array([-1 if x is None else int(np.searchsorted(known, x + b"\1")) for x in above])
    shut = ~(sides[0] | sides[1])
    rolled_up([np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)], parents, shut, n, size, children, leaves, saved)
    ends: list = [None] * len(known)
    for k, x in zip(at.tolist(), c["ends"].to_pylist(), strict=True):
        ends[k] = x or ends[k]
    keys16 = [c["key"][int(i)].as_py() for i in one]
    columns = [np.full(len(known), shard.min() // fan), np.where(shut, -1, 0), keys16, above, depth, *sides, n, conv, children, leaves, saved, size, ends]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, _EDGE_TYPES, strict=True)], names=_EDGE_NAMES)


def _merging(fan: int, last_tier: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _merged(table, fan, last_tier)


def _folded(values: np.ndarray, at: np.ndarray, n: int, fold: np.ufunc, start: int) -> np.ndarray:
    out = np.full(n, start, dtype=np.int64)
    fold.at(out, at, values)
    return out


def upper_nodes(edges: DataFrame, n_shards: int, fan: int = FAN) -> DataFrame:
    """The nodes that several shards may hold, whole: key, above (the parent's key), depth, n, conv, children, leaves, saved, ends.

    Tiers of up to fan neighbouring shards merge until one is left: a task gets two paths of a trie's depth for each of its shards.
    """
    done: DataFrame | None = None
    while True:
        last_tier = n_shards <= fan

        merged = stored(edges.groupBy(F.floor(F.col("shard") / fan).cast("int").alias("tier")).applyInArrow(_merging(fan, last_tier), _EDGE), "upper-nodes")
        finished = merged.where("node = -1")
        done = finished if done is None else done.union(finished)
        if last_tier:
            return done.select("key", "above", "depth", "n", "conv", "children", "leaves", "saved", "ends")
        edges, n_shards = merged.where("node <> -1"), -(-n_shards // fan)


def trie_nodes(tries: DataFrame) -> DataFrame:
    """All nodes of tries (shards()): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    edges = stored(tries.mapInArrow(_edge_rows, _EDGE), "edges")
    n_shards = (edges.agg(F.max("shard")).first()[0] or 0) + 1
    upper = stored(upper_nodes(edges, n_shards), "upper")
    named = edges.select("shard", "node", "key").join(upper.select("key", "conv"), "key").groupBy("shard").agg(F.collect_list("node").alias("nodes"), F.collect_list("conv").alias("convs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, trie, (nodes, convs) in _tries(batches):
            shut, n, conv, children, leaves, saved = _summed(trie)
            conv[nodes] = convs
            depth = np.repeat(np.arange(len(trie.levels)), [b - a for a, b in trie.levels])
            ended = dict(zip(trie.end_nodes.tolist(), range(len(trie.end_nodes)), strict=True))
            at = np.flatnonzero(shut)
            for k in range(0, len(at), 20_000):
                i = at[k : k + 20_000]
                ends = [trie.end_digests[ended[x]].tobytes().hex() if x in ended else _NO_ENDS for x in i.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (conv[i], depth[i].astype(np.int64), conv[trie.parents[i]], n[i], children[i], leaves[i], saved[i])] + [pa.array(ends, pa.string())], names=[*NODES, "ends_sha256"])

    lower = tries.join(named, "shard").mapInArrow(run, ", ".join([*(f"{c} long" for c in NODES), "ends_sha256 string"]))
    parents = upper.select(F.col("key").alias("above"), F.col("conv").alias("parent_conv_id"))
    top = upper.join(parents, "above", "left").select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), F.lit(_NO_ENDS)).alias("ends_sha256"))
    return lower.union(top)


def prefix_trie(turns: DataFrame, branching: int | None = None, block: int = 100, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the prefix trie of conversations (conv_id, turn, role, text): one row for each different sequence of first turns, see trie_nodes.

    conv_id and parent_conv_id are smallest members, and the root has depth 0 and no parent; saved_tokens are the code points that are
    stored once instead of once a member, summed over the subtree. Conversations without turns are members of the root; equal rows are
    turns each; other columns are ignored. No turns give no rows. For branching see sequences().
    """
    found = stored(sequences(turns, branching, block), "sequences")
    members = stored(sequence_members(found), "members")
    return trie_nodes(shards(found, members, shard_turns))
