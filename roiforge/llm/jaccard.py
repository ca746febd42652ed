"""N-gram Jaccard join by multiple global orders.

A document's set are its distinct word n-grams, as 64-bit hashes. Under a global order of n-grams, two sets with Jaccard
similarity of at least t share at least k of the first n - ceil(t*n) + k n-grams of either (their heads). Each order filters
by itself: n-grams of a head that occur in no other head can't be shared; of the others the rarest ones suffice, so
that passages which many documents repeat join nothing. Documents that share one of these n-grams fall into one part;
the parts under the first order are split again under the second. Parts only say who meets: within them the filters are
intersected pair by pair. A pair is verified, on its whole sets, if its sizes are near and its prefixes share an n-gram under each of
three orders: the two global ones and that by rarity among those who meet.

Documents with equal sets form a class and are searched once. Hashes decide equality of n-grams; two different ones of
a document collide with a chance of about 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roiforge.llm.common import batch_words, block_tasks, components, forest, mixed, sliced, spread_tasks, stored

#: Documents of a verifying block; documents of a common n-gram that meet in one task, about.
BLOCK, HUB = 2000, 500
ORDERS = (101, 202)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Distinct hashes of each text's word n-grams, ascending. With fewer words than that, all of them are one n-gram."""
    hashes, at = batch_words(column)
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    if n >= words:
        whole = n - words + 1
        for k in range(words):
            rolled[:whole] = mixed(rolled[:whole] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + whole], k + 1)
    found = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= words:
            found.append(np.unique(rolled[s : e - words + 1]))
        elif e > s:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(e - s):
                one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + hashes[s + k : s + k + 1], 50 + k)
            found.append(one)
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def _prefix(n, percent: int):
    """n - ceil(t*n) + 1: so many n-grams hold one that a similar set shares."""
    return n - (-(-n * percent // 100)) + 1


def head(shingles: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first 2p - 1 n-grams under an order; similar sets share at least p of them, p by the smaller one."""
    p = _prefix(len(shingles), percent)
    ranked = mixed(shingles, order)
    n = min(len(ranked), 2 * p - 1)
    return np.sort(np.partition(ranked, n - 1)[:n] if n else ranked).view(np.int64)


def parts_by_order(heads: DataFrame, percent: int) -> DataFrame:
    """(rep, n, part, head array<long>) -> (rep, part): parts under this order within the former parts, those of one document left out.

    Each n-gram of a head is counted within its part. need is the number of n-grams that a head shares with that of any
    similar set, which may be smaller; so of the head's n-grams, rarest first, all but need - 1 must hold a shared one.
    """
    tokens = heads.select("rep", "n", "part", F.size("head").alias("h"), F.explode("head").alias("token"))
    counted = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("part", "token"))).where("df > 1")
    least = F.ceil(F.col("n") * percent / 100)
    need = least - F.ceil(least * percent / 100) + 1
    rare = F.sort_array(F.collect_list(F.struct("df", "token")))
    most = F.col("h") - F.least(F.col("need"), F.col("h")) + 1 - (F.col("h") - F.size("shared"))
    chosen = counted.withColumn("need", need).groupBy("rep", "part", "h", "need").agg(rare.alias("shared")).withColumn("most", most).where("most > 0")
    salt = F.when(F.col("s.df") > HUB, F.pmod(F.xxhash64(F.lit(5), F.col("rep")), F.ceil(F.col("s.df") / HUB))).otherwise(0).cast("int")
    joined = chosen.select("rep", "part", F.explode(F.slice("shared", F.lit(1), F.col("most").cast("int"))).alias("s")).select("rep", "part", F.col("s.token").alias("token"), F.col("s.df").alias("df"), salt.alias("salt"))
    # documents of an n-gram link to the least one: of about HUB of them first, and these least ones, where there are several, to the least of all
    led = joined.withColumn("first", F.min("rep").over(Window.partitionBy("part", "token", "salt")))
    leaders = led.where(F.col("df") > HUB).select("part", "token", "first").distinct()
    least = leaders.groupBy("part", "token").agg(F.min("first").alias("least"))
    edges = led.select(F.col("rep").alias("a"), F.col("first").alias("b")).union(leaders.join(least, ["part", "token"]).select("first", "least")).where("a <> b").distinct()
    return components(edges).select(F.col("node").alias("rep"), F.col("component").alias("part"))


def _first(shingles: np.ndarray, order: int, percent: int) -> frozenset:
    """The prefix of a set under a global order: similar sets share one of its n-grams."""
    ranked = mixed(shingles, order)
    n = _prefix(len(ranked), percent)
    return frozenset(np.partition(ranked, n - 1)[:n].tolist())


def verified_links(sets: list[np.ndarray], side: np.ndarray, same: bool, percent: int, every: bool = False) -> tuple[list[int], list[int]]:
    """Links among sets (indices): all of them with `every`, else enough to connect what is connected (pairs already connected aren't verified).

    Sets that share one of their first n-grams by rarity within the block meet; of these pairs those go on whose prefixes share an
    n-gram under each global order as well.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, local = np.unique(flat, return_inverse=True)
    rarity = np.bincount(local)
    at = np.concatenate([[0], np.cumsum(sizes)])
    parent = list(range(len(sets)))
    firsts: dict[int, tuple[frozenset, ...]] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def first(k: int) -> tuple[frozenset, ...]:
        if k not in firsts:
            firsts[k] = tuple(_first(sets[k], order, percent) for order in ORDERS)
        return firsts[k]

    def shared_under_all(i: int, j: int) -> bool:
        return all(not p.isdisjoint(q) for p, q in zip(first(i), first(j), strict=True))

    postings: dict[int, list[int]] = {}
    mark = np.zeros(len(rarity), dtype=bool)
    a, b = [], []
    for i in np.argsort(sizes, kind="stable").tolist():
        mine = local[at[i] : at[i + 1]]
        rare = mine[np.lexsort((mine, rarity[mine]))[: int(_prefix(sizes[i], percent))]].tolist()
        met = {j for t in rare for j in postings.get(t, ())}
        for t in rare:
            if rarity[t] > 1:
                postings.setdefault(t, []).append(i)
        near = [j for j in met if 100 * sizes[j] >= percent * sizes[i] and (same or side[i] != side[j]) and (every or root(i) != root(j)) and shared_under_all(i, j)]
        if not near:
            continue
        mark[mine] = True
        lengths = sizes[near]
        inside = mark[np.concatenate([local[at[j] : at[j + 1]] for j in near])]
        both = np.add.reduceat(inside.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        mark[mine] = False
        for j in np.array(near)[100 * both >= percent * (sizes[i] + lengths - both)].tolist():
            if every or root(i) != root(j):
                parent[root(i)] = root(j)
                a.append(i)
                b.append(j)
    return a, b


def _search(docs: DataFrame, words: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents read: doc_id, n, digest; classes: digest, n, rep, copies; links a, b between classes' rep and digest)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def first_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            sets = shingle_sets(b.column(1), words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            heads = [head(s, ORDERS[0], percent) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(heads), pa.int64()))], names=["doc_id", "n", "digest", "head"])

    seen = stored(texts.mapInArrow(first_reading, "doc_id long, n long, digest binary, head array<long>"), "shingles")
    full = seen.where("n > 0 and doc_id is not null")
    heads = full.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.first("head").alias("head")).select("rep", "n", F.lit(0).cast("long").alias("part"), "head")
    parts = stored(parts_by_order(heads, percent), "parts")

    def second_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            sets = shingle_sets(b.column(2), words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "part", "n", "digest", "set"])

    # only texts of documents that have met another one are read again
    again = texts.join(parts.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "part", "text").mapInArrow(second_reading, "rep long, part long, n long, digest binary, set binary")
    sets = stored(again.where("n > 0").dropDuplicates(["rep", "digest"]), "shingle-sets")

    def second_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            found = [head(np.frombuffer(s, dtype=np.uint64), ORDERS[1], percent).tolist() for s in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["rep", "n", "part", "head"])

    finer = stored(parts_by_order(sets.select("rep", "n", "part", "set").mapInArrow(second_heads, "rep long, n long, part long, head array<long>"), percent), "finer-parts")
    # similar sets lie in the same or in neighbouring bands of size; a band's members meet those of the next one as visitors
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) / (1 + 1e-9)).cast("int") if percent < 100 else F.col("n")
    rows = sets.select("rep", "digest", "n").join(finer, "rep").withColumn("own", band)
    rows = rows.withColumn("to", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(0).alias("role")), F.struct((F.col("own") - 1).alias("band"), F.lit(1).alias("role"))))).select("rep", "digest", "part", "to.band", "to.role")
    tasks = block_tasks(rows, ["part", "band"], ["rep", "digest"], BLOCK).drop("role")
    tasks = spread_tasks(tasks.join(sets.select("rep", "digest", "set"), ["rep", "digest"]), ["part", "band"])

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        a, b = verified_links([np.frombuffer(s, dtype=np.uint64) for s in table.column("set").to_pylist()], table.column("side").to_numpy(), key[2].as_py() == key[3].as_py(), percent, every)
        if every:
            digest = table.column("digest")
            return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64()), "digest_a": digest.take(pa.array(a, pa.int64())), "digest_b": digest.take(pa.array(b, pa.int64()))})
        u, v = forest(rep[a], rep[b]) if a else (rep[:0], rep[:0])
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    links = tasks.groupBy("part", "band", "x", "i").applyInArrow(verify, "a long, b long" + (", digest_a binary, digest_b binary" if every else ""))
    return seen, full.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), stored(links, "jaccard-links")


def _classified(seen: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    full = seen.where("n > 0 and doc_id is not null")
    # classes that meet in a repeated id
    twice = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    meeting = full.select("doc_id", "digest", "n").join(twice, "doc_id", "left_semi").join(classes, ["digest", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(links.select("a", "b").union(meeting))
    return classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", "copies", F.coalesce("component", "rep").alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, a row for each row.

    Words are maximal runs outside [\\x20\\x09-\\x0D], A-Z lower-cased. Sets link where 100 * common >= percent * union. Texts
    without words (null ones too) and rows with null ids link with nothing: their component_id is their doc_id. Rows with the same id are
    one node. Other columns are ignored. Links that add nothing to the components aren't verified; jaccard_links counts all.
    """
    seen, classes, links = _search(docs, words, percent, False)
    verdicts = _classified(seen, classes, links)
    linked = seen.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest").join(verdicts, ["digest", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(seen.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))


def jaccard_links(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """As jaccard_components, with n_links: how many other documents each one links with, copies of its own set among them.

    All pairs of different sets that meet are verified, so a group of near copies costs the square of its number of different sets, in
    blocks. Rows with the same id count as documents of their own.
    """
    seen, classes, links = _search(docs, words, percent, True)
    ends = links.select(F.col("digest_a").alias("digest"), F.col("digest_b").alias("other")).union(links.select("digest_b", "digest_a"))
    partners = ends.join(classes.select(F.col("digest").alias("other"), "copies"), "other").groupBy("digest").agg(F.sum("copies").alias("partners"))
    verdicts = _classified(seen, classes, links).join(partners, "digest", "left").select("digest", "n", "component_id", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = seen.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest").join(verdicts, ["digest", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return linked.union(seen.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id", F.lit(0).cast("long")))
