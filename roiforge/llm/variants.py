"""Spelling variants: words of a corpus that differ by one code point, and the commoner form that each leads to.

Two words are near if one becomes the other by inserting, deleting or replacing one code point. Every word gives a key for each
string that deleting one code point leaves: prefix and suffix sums of a polynomial hash make them all in a few vector operations. Keys are
partitioned by their leading bits, sorted in each partition, and what shares a key is compared as strings. Words that leave the same string
at the same place differ by a replacement, a word that is such a string by a deletion; each near pair meets in exactly one such group, so
numbers of near words add up over groups and no pairs are written.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roiforge.llm.common import _power_tables, mixed, sliced, stored

#: Words that a task counts before it passes the counts on.
MOST_COUNTED = 400_000
#: Keys of a partition (one task's group), about.
PART_KEYS = 200_000

_WORD = bytearray(b" " * 256)
for _b in (*range(0x61, 0x7B), *range(0xC0, 0x100)):
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32
_WORD = bytes(_WORD)


# --- words -----------------------------------------------------------------------------------------------------------


def _runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1, A-Z lowered: a byte is a code point, and other code points end a run."""
    return text.encode("latin-1", "replace").translate(_WORD).split()


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def word_counts(docs: DataFrame, least: int = 3, shortest: int = 5, typos: int | None = None) -> DataFrame:
    """word string, n long: words of at least `shortest` code points with at least `least` occurrences in all texts.

    With typos=m, a code point is deleted from one run in m: with h the CRC-32 of `<doc_id>:<run>`, where m divides h, the one at h modulo the
    length. Null and empty texts have no words, a null doc_id counts as empty, repeated rows count each time. Counts are added up in each
    task, then before the shuffle, so a word of any frequency costs a task one row for each of the tasks before it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in totals], pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
            totals.clear()
            return batch

        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(_runs(text))
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, k in found.items():
                    if len(run) < shortest:
                        continue
                    if typos:
                        h = zlib.crc32(_utf8(run), start)
                        if h % typos == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                    totals[run] += k
            if len(totals) > MOST_COUNTED:
                yield told()
        if totals:
            yield told()

    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- deletion keys ---------------------------------------------------------------------------------------------------


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its own key (place -1) and those of the strings left by deleting the code point at each place.

    Gives each key's word (by number), place, whether it is the last place of a run of equal code points (so that each different string
    has one), and the key: 64 bits of a polynomial hash and the length.
    """
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    up, down = _power_tables(n + 2)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64), 5) * up[:n], out=sums[1:])
    first = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(n)
    start, end = first[:-1][owner], first[1:][owner]
    # what stands before the place, and what stands after it moved one place down; both counted from the word's start
    left = (sums[at] - sums[start]) * down[start]
    right = (sums[end] - sums[at + 1]) * down[start + 1]
    whole = (sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]
    keys = np.concatenate([mixed(whole + lengths.astype(np.uint64), 9), mixed(left + right + (lengths[owner] - 1).astype(np.uint64), 9)])
    last = np.ones(n, dtype=bool)
    last[:-1] = (codes[:-1] != codes[1:]) | (owner[:-1] != owner[1:])
    return np.concatenate([np.arange(len(words)), owner]), np.concatenate([np.full(len(words), -1), at - start]), np.concatenate([np.zeros(len(words), dtype=bool), last]), keys


def _key_rows(vocabulary: DataFrame, bits: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 5000):
            ids = b.column(0).to_numpy()
            owner, place, last, keys = deletion_keys(b.column(1).to_pylist())
            for k in range(0, len(keys), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array((keys[part] >> np.uint64(64 - bits)).astype(np.int32)), pa.array(keys[part].view(np.int64)), pa.array(ids[owner[part]]), pa.array(place[part].astype(np.int32)), pa.array(last[part])], names=["radix", "key", "id", "place", "last"])

    return vocabulary.select("id", "word").mapInArrow(make, "radix int, key long, id long, place int, last boolean")


def _shared(table: pa.Table) -> pa.Table:
    """Of a partition's keys those that may make near words: several at one place, or a word's own beside deletions."""
    key, place, last = (table.column(c).to_numpy() for c in ("key", "place", "last"))
    order = np.lexsort((place, key))
    k, p, final = key[order], place[order], last[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_place = new_key | np.concatenate([[True], p[1:] != p[:-1]])
    group, cell = np.cumsum(new_key) - 1, np.cumsum(new_place) - 1
    # words have different strings, so only a collision lets two own keys meet; they are told apart later
    wholes = np.bincount(group, p < 0)[group] > 0
    deletions = np.bincount(group, final)[group] > 0
    replaced = (p >= 0) & (np.bincount(cell)[cell] > 1)
    return table.select(["id", "place", "last"]).take(pa.array(np.sort(order[replaced | (wholes & final) | (deletions & (p < 0))])))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near and best (struct less, word, id: the near word of largest n, less = -n, ties by code points) of each word that has near words.

    vocabulary has id long, word string (different ones) and n long, and is read several times. The number of partitions follows from the number of keys.
    """
    total = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total / PART_KEYS)))))
    meeting = stored(_key_rows(vocabulary, bits).groupBy("radix").applyInArrow(_shared, "id long, place int, last boolean"), "meeting")
    rows = meeting.join(vocabulary, "id")
    rest = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.expr("left(word, place)"), F.expr("substring(word, place + 2)")))
    rows = stored(rows.select("id", "place", "last", rest.alias("rest"), F.struct((-F.col("n")).alias("less"), "word", "id").alias("me")), "meeting-words")
    # replacements: all words of a group are near one another, and the best one of each is the group's first, or second for the first
    same = Window.partitionBy("rest", "place")
    by_n = same.orderBy("me")
    replaced = rows.where("place >= 0").select("id", F.count(F.lit(1)).over(same).alias("k"), F.row_number().over(by_n).alias("r"), F.first("me").over(by_n).alias("top"), F.lead("me").over(by_n).alias("next"))
    replaced = replaced.where("k > 1").select("id", (F.col("k") - 1).alias("k"), F.when(F.col("r") == 1, F.col("next")).otherwise(F.col("top")).alias("best"))
    # deletions: a string left by deleting is itself a word
    longer = rows.where("last").select("rest", F.col("me").alias("longer"))
    met = rows.where("place < 0").select("rest", F.col("me").alias("shorter")).join(longer, "rest")
    both = met.select(F.explode(F.array(F.struct(F.col("shorter").alias("me"), F.col("longer").alias("best")), F.struct(F.col("longer").alias("me"), F.col("shorter").alias("best")))).alias("p"))
    deleted = both.select(F.col("p.me.id").alias("id"), F.lit(1).cast("long").alias("k"), F.col("p.best").alias("best"))
    return replaced.union(deleted).groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """id, root: where following the links (id, up) ends. Each round doubles the steps; forms at least double n, so chains are short and rounds few."""
    now = stored(links, "forms")
    while True:
        further = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = stored(now.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "forms")
        now = step.select("id", "up")
        if not step.where("moved").take(1):
            return now.withColumnRenamed("up", "root")


def spelling_groups(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n from counts (word, n; different words).

    A word's form is its near word of largest n (ties: the first in code-point order) if that n is at least ratio times its own, else null;
    root follows forms to the last and is the word itself where there is none. Empty counts give no rows; words of one code point can be near too.
    """
    vocabulary = stored(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary").select("id", "word", "n")
    near = near_words(vocabulary).withColumnRenamed("id", "near_id")
    told = vocabulary.join(near, F.col("id") == F.col("near_id"), "left").withColumn("ok", -F.col("best.less") >= ratio * F.col("n"))
    told = stored(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(F.col("ok"), v).alias(c) for c, v in (("form", F.col("best.word")), ("form_n", -F.col("best.less")), ("form_id", F.col("best.id"))))), "forms")
    ends = _roots(told.where("form_id is not null").select("id", F.col("form_id").alias("up")))
    # a root is where many words end: its string goes to them by a join on its id, the words' side being slim
    named = ends.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return told.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
