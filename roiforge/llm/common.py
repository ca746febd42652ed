"""What several operators share: shared folders, word hashing, tokenizing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Arrow batches hold whole texts, so a batch takes few rows.
BATCH_ROWS = 2000
TOKENIZER_FILE = "word_bpe_49k.json"
#: Entries of a worker's cache of encoded words; beyond it the cache starts anew.
CACHE_WORDS = 1_500_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that is unset it is set to a local folder if driver and executors are one process (as in tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="roiforge-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


_folders: list[str] = []


def forget_folders(spark: SparkSession) -> int:
    """Deletes the folders that operators have written since the last call, and gives their number.

    For when results are no longer read: DataFrames that operators returned may still read from these folders.
    """
    n = len(_folders)
    while _folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a shared folder and read back: cuts lineage, survives the loss of an executor, and is computed once."""
    path = shared_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, planned passes get Arrow batches of few rows: they hold whole texts. The session's own setting comes back after it."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows, so that what a pass makes of whole texts stays small whatever the session's batch size is."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_fields(df: DataFrame, added: str) -> StructType:
    """df's schema with the added fields, DDL, at its end."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


# --- words -----------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.ones(1, dtype=np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
            _powers[name] = table
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a UTF-8 byte array, maximal runs of bytes outside [\\x20\\x09-\\x0D]: 64-bit hashes, starts, ends.

    Rolling polynomial over random byte values, so that all words of a batch take a few vector operations.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), dtype=np.uint64)
    step = 1 << 17
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + step, side="right")), first + 1)
        part = data[base : ends[last - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[_LOWER[part] if lower else part] * up[: len(part)], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out, starts, ends


def batch_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column and, for each row, where its words start among them (one more entry at the end).

    A separator byte stands between texts so that no word spans two rows. Null texts have no words.
    """
    texts = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    hashes, starts, _ = word_hashes(data, lower)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes, np.searchsorted(starts, offsets)


# --- tokens ----------------------------------------------------------------------------------------------------------

_tokenizers: dict[str, tuple] = {}
_MARK = "\u2605"
_PUNCTUATION = b".,!?%&$#*|;:"


def _encode_words(tokenizer, known: dict[bytes, bytes], new: list[bytes]) -> None:
    """Adds the ids of new words, none of which holds the mark.

    The words are encoded as one string with the mark, which has an id of its own, between them: one call for many is much
    cheaper than one for each. A run of punctuation after an ASCII letter or digit is a match of its own, so it is encoded apart.
    """
    mark = tokenizer.encode(_MARK, add_special_tokens=False).ids
    heads = {w: w.rstrip(_PUNCTUATION) for w in new}
    heads = {w: h if h[-1:].isalnum() else w for w, h in heads.items()}
    parts = list({x for w, h in heads.items() for x in (h, w[len(h) :]) if x and x not in known})
    for k in range(0, len(parts), 5000):
        some = parts[k : k + 5000]
        ids = np.array(tokenizer.encode_batch_fast([f" {_MARK} ".join(w.decode() for w in some)], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = np.flatnonzero(ids == mark[0])
        if len(mark) != 1 or len(cut) != len(some) - 1:
            raise ValueError("this tokenizer has no id of its own for the mark")
        data = ids.tobytes()
        for w, s, e in zip(some, [0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), len(data)], strict=True):
            known[w] = data[s:e]
    for w, h in heads.items():
        if w not in known:
            known[w] = known[h] + known[w[len(h) :]]


def _splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer normalises and splits as the default vocabulary does, so that its words can be encoded one by one."""
    import json

    with open(path, encoding="utf-8") as f, open(tokenizer_path(), encoding="utf-8") as g:
        mine, known = json.load(f), json.load(g)
    return all(mine.get(k) == known.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")) and all("<|" in t["content"] for t in mine.get("added_tokens") or [])


def token_bytes(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without special tokens; null counts as empty.

    The default tokenizer's pattern never matches across white space, and neither does its normalisation, so that a text's ids are
    those of its white-space-separated words one after the other. Words recur, so each worker keeps the ids of those
    seen; the tokenizers library encodes the others. Texts that hold the mark or the strings of added tokens are encoded whole, and so are all
    texts with a tokenizer that normalises or splits in another way.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {} if _splits_at_spaces(path) else None)
    tokenizer, known = _tokenizers[path]
    if known is None:
        for t in texts:
            yield np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        return
    step = 200
    for k in range(0, len(texts), step):
        some = [t or "" for t in texts[k : k + step]]
        plain = [_MARK not in t and "<|" not in t for t in some]
        words = [(t.encode().lower() if t.isascii() else t.encode()).split() if p else [] for t, p in zip(some, plain, strict=True)]
        if len(known) > CACHE_WORDS:
            known.clear()
        new = {w for x in words for w in x if w not in known}
        if new:
            _encode_words(tokenizer, known, list(new))
        for t, x, p in zip(some, words, plain, strict=True):
            yield b"".join([known[w] for w in x]) if p else np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, component), the component being its smallest node.

    Alternates large-star and small-star steps; each replaces a node's links by links to the smallest node it knows, so
    that the number of edges never grows, and a logarithmic number of rounds is enough in practice. Minima are
    pre-aggregated before the shuffle. The links of a node with very many meet its minimum in a join, two numbers a link, which
    adaptive execution splits where such a partition is large (skew join). Each round is written to the shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    now = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node links to the smallest of the node and its neighbours
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").where("a <> b").union(least.selectExpr("a", "m b")).distinct()
        now = stored(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    # settled edges are stars around each component's smallest node
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


# --- pairs within groups, in blocks ----------------------------------------------------------------------------------


#: Groups that need more than one block are broadcast up to this many rows (of five numbers); beyond it they are joined with salted keys.
MOST_WIDE, SALTS = 100_000, 64


def block_tasks(rows: DataFrame, keys: list[str], member: list[str], block: int) -> DataFrame:
    """Deals the pairs within groups to tasks of bounded size, all of them, each pair to one task.

    rows have keys, the columns `member` that tell a group's rows apart, and a role: 0 for a group's own members, 1 for visitors. They should
    be slim: what is compared is joined to the result by member. Wanted are the pairs of two members and those of a visitor and a
    member. Both are hashed by `member` to blocks of about `block` rows; a task (x, i) compares block x (side 1) with the members'
    block i (side 0), or the block i with itself where x = i and side 1 is absent. Groups without pairs are left out.

    No row of a group that needs several blocks is shuffled by the group alone: such groups' counts go to the rows.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*keys).agg(F.count(F.when(F.col("role") == 0, 1)).alias("nb"), F.count(F.when(F.col("role") == 1, 1)).alias("nq")).where("nb > 0 and nb + nq > 1")
    counts = stored(counts, "block-counts")
    wide = counts.where(F.greatest("nb", "nq") > block).select(*keys, F.ceil(F.col("nb") / block).alias("nb"), F.ceil(F.col("nq") / block).alias("nq"))
    hashed = F.xxhash64(F.lit(3), *member)
    if wide.count() <= MOST_WIDE:
        told = rows.join(F.broadcast(wide), keys, "left")
    else:
        salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = rows.withColumn("salt", F.pmod(hashed, F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")
    # the others have a block of members and one of visitors at most, so they may meet in a task
    narrow = counts.where(F.greatest("nb", "nq") <= block).select(*keys, F.least("nq", F.lit(1)).alias("one"))
    small = told.where("nb is null").drop("nb", "nq").join(narrow, keys).select(*rows.columns, F.lit(1).cast("long").alias("nb"), F.col("one").cast("long").alias("nq"))
    dealt = told.where("nb is not null").select(*rows.columns, "nb", "nq").union(small).withColumn("at", F.pmod(hashed, F.when(F.col("role") == 0, F.col("nb")).otherwise(F.greatest("nq", F.lit(1)))))
    place = lambda x, i, side: F.struct(x.cast("int").alias("x"), i.cast("int").alias("i"), F.lit(side).alias("side"))
    at = F.col("at")
    as_member = F.transform(F.sequence(at, F.col("nb") + F.col("nq") - 1), lambda x: place(x, at, 0))
    as_other = F.when(at > 0, F.transform(F.sequence(F.lit(0).cast("long"), at - 1), lambda i: place(at, i, 1))).otherwise(F.array().cast("array<struct<x:int,i:int,side:int>>"))
    as_visitor = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda i: place(F.col("nb") + at, i, 1))
    return dealt.withColumn("task", F.explode(F.when(F.col("role") == 0, F.concat(as_member, as_other)).otherwise(as_visitor))).select(*rows.columns, "task.*")


def spread_tasks(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """tasks shuffled by keys and block pair, so that a group's blocks are grouped in different tasks."""
    return tasks.repartition(*keys, "x", "i")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to stars: as many rows as nodes less components, each node beside its component's least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    mine = label != np.arange(len(nodes))
    return nodes[mine], nodes[label[mine]]
