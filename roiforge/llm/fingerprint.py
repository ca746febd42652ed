"""Canonical exact digests of documents.

A text is canonicalised (NFKC, case folding, white space folded to single spaces), its canonical UTF-8 bytes are hashed
with 128-bit xxhash, and equal digests count as equal only where the canonical bytes are equal too.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.llm.common import partitions, sliced, stored, text_or_empty, with_fields


#: Digests (of 32 characters) that are broadcast at most.
MOST_BROADCAST = 200_000


def canonical(text: str | None) -> bytes:
    """NFKC, case folding, NFKC again (folding can undo it), runs of white space as one space; null counts as empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def likeness(a: bytes, b: bytes, digest_a: str, digest_b: str) -> float:
    """1 if two canonical texts are the same, digests first and then bytes; else 0: the digest knows no degrees."""
    return float(digest_a == digest_b and a == b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fingerprint string added; other columns pass through, one named fingerprint is replaced.

    Null and empty texts, and texts of white space alone, share the digest of no bytes.
    """
    rest = docs.drop("fingerprint")
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [digest(canonical(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "fingerprint"])

    return rest.mapInArrow(run, with_fields(rest, "fingerprint string"))


def _with_bytes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [canonical(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest, texts), pa.string()), pa.array(texts, pa.binary())], names=["doc_id", "fingerprint", "bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, bytes binary")


def group_tables(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups by fingerprint: fingerprint, group_id, copies; rows of fingerprints that different texts share: doc_id, fingerprint, group_id, copies).

    prints has doc_id and fingerprint of every row of docs. Digests group the rows; of digests that several rows share, min and max of the
    canonical bytes are compared, both pre-aggregated before the shuffle, so a group of any size costs a task one row per mapper, and texts
    that are alone with their digest don't move. Where the two are equal, all members are equal byte by byte; where they aren't (a
    collision), the bytes themselves join the key, and the group is in the second table.
    """
    counts = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies")), "digest-groups")
    several = counts.where("copies > 1").select("fingerprint")
    # few digests go to the rows, so that only texts with copies move, pre-aggregated; many are joined by shuffle
    several = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
    rows = _with_bytes(docs)
    bytes_ = rows.drop("doc_id").join(several, "fingerprint").groupBy("fingerprint").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    clashes = stored(bytes_.where("lo <> hi").select("fingerprint"), "digest-clashes")
    split = rows.join(clashes, "fingerprint")
    apart = split.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return counts.join(clashes, "fingerprint", "left_anti"), split.join(apart, ["fingerprint", "bytes"]).select("doc_id", "fingerprint", "group_id", "copies")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents with the same canonical text: doc_id, fingerprint, group_id (least doc_id of the group), copies.

    A row for each row; rows with null ids count as members. See group_tables.
    """
    prints = stored(_with_bytes(docs).drop("bytes"), "digests")
    same, apart = group_tables(docs, prints)
    return prints.join(same, "fingerprint").select("doc_id", "fingerprint", "group_id", "copies").union(apart)


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id: int | None, text: str, mine: tuple[bytes, str], after: str, theirs: tuple[bytes, str]) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    form = canonical(edited)
    edited_print = digest(form)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine[1], edited_print, likeness(mine[0], form, mine[1], edited_print), likeness(mine[0], theirs[0], mine[1], theirs[1])


def edits_and_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of the next document.

    The next document is the next by doc_id (nulls first, equal ids by text); the last one's is the first. A single
    document is its own next one. One range shuffle by doc_id puts neighbours side by side; each partition compares its
    own and leaves its first and last text, which are then joined across partitions. The driver holds the partitions' numbers.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    names = [f.split()[0] for f in _PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, first = TaskContext.get().partitionId(), None, None

        def rows(found: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            n = len(found)
            kinds = [pa.field(x, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for x, k in (f.split() for f in _PAIRS.split(", "))]
            columns = [pa.array([r[i] for r in found] + [None] * len(edges), f.type) for i, f in enumerate(kinds)]
            columns[0] = pa.array([r[0] for r in found] + [e[2] for e in edges], pa.int64())
            extra = [pa.array([None] * n + [e[i] for e in edges], k) for i, k in ((0, pa.int32()), (1, pa.int32()), (3, pa.string()))]
            return pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "part", "last", "text"])

        for b in sliced(batches):
            found = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                form = canonical(text)
                now = (doc_id, text, (form, digest(form)))
                if before is None:
                    first = now
                else:
                    found.append(_compared(*before, text, now[2]))
                before = now
            yield rows(found, [])
        if before is not None:
            yield rows([], [(part, 0, first[0], first[1]), (part, 1, before[0], before[1])])

    table = stored(ordered.mapInArrow(run, f"{_PAIRS}, part int, last int, text string"), "neighbours")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if k == "long" else pa.string() if k == "string" else pa.float64() for k in (f.split()[1] for f in _PAIRS.split(", "))]
        for b in batches:
            found = []
            for doc_id, text, after in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x, y = canonical(text), canonical(after)
                found.append(_compared(doc_id, text, (x, digest(x)), after, (y, digest(y))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

    # the last text of a partition meets the first one of the next partition that has any: a row of two texts for each partition
    edges = table.where("part is not null").select("doc_id", "part", "last", "text")
    parts = sorted(r[0] for r in edges.select("part").distinct().collect())
    following = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, following int")
    heads = edges.where("last = 0").select(F.col("part").alias("following"), F.col("text").alias("after"))
    ends = edges.where("last = 1").join(F.broadcast(following), "part").join(heads, "following").select("doc_id", "text", "after").mapInArrow(joined, _PAIRS)
    return table.where("part is null").select(*names).union(ends)
