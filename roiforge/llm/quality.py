"""Quality classification by co-training.

Two views of a document: its content (relative frequencies of byte trigrams, hashed) and its page metadata (source, language,
length). A logistic classifier for each view is fitted on labelled documents. In each round both score all unlabelled documents, and
either one labels some of those it is sure of for the other one, as many good as bad ones, drawn by lottery. The views are then
calibrated and combined on labelled documents kept apart, a further part of which measures the result, and every document is scored on
its whole text.

Fitting uses at most LABELLED labelled documents, drawn by a hash of their ids, and EXCHANGED pseudo-labels for each view and round, drawn
from all documents; all documents are scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.llm.common import mixed, sliced, stored, text_or_empty, with_fields

LABELLED, ROUNDS, EXCHANGED = 4000, 3, 200
#: How sure a view must be of a document to label it.
SURE = 0.98
TEXT_BITS, META_BITS = 15, 12
#: Columns that score() adds.
ADDED = ("p_text", "p_meta", "p_quality", "keep")
#: Share of the good documents kept apart that the threshold must keep; it rejects half of the bad ones at least where that keeps ENOUGH_GOOD.
KEEP_GOOD, ENOUGH_GOOD = 0.998, 0.99


class Model(NamedTuple):
    text: np.ndarray  # weights, and the bias as last entry
    meta: np.ndarray
    joint: tuple[float, float, float]  # of the text logit, the metadata logit, and the bias
    threshold: float
    held_out: dict[str, float]


def text_slots(data: np.ndarray) -> np.ndarray:
    """Slot of each byte trigram."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    x = data.astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - TEXT_BITS)).astype(np.int64)


def _meta_slots(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    import xxhash

    size = "none" if n_chars is None else str(int(2 * math.log2(max(n_chars, 0) + 1)))
    return [xxhash.xxh64_intdigest(f"{k}={v}") % (1 << META_BITS) for k, v in (("source", source), ("lang", lang), ("size", size))]


def _sparse(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = [len(i) for i, _ in rows]
    return np.repeat(np.arange(len(rows)), n), np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])


def _text_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        slots, n = np.unique(text_slots(np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)), return_counts=True)
        out.append((slots, 30.0 * n / max(1, n.sum())))
    return out


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, steps: int = 80, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression by full-batch AdaGrad."""
    at, slot, value = _sparse(rows)
    w, past = np.zeros(size + 1), np.full(size + 1, 1e-6)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        z = np.bincount(at, w[slot] * value, minlength=len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-z)) - y) * weight
        g = np.concatenate([np.bincount(slot, e[at] * value, minlength=size), [e.sum()]])
        g[:-1] += penalty / len(rows) * w[:-1]
        past += g * g
        w -= 0.5 * g / np.sqrt(past)
    return w


def _logits(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    at, slot, value = _sparse(rows)
    return np.bincount(at, w[slot] * value, minlength=len(rows)) + w[-1]


def _line(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of z, with a bias: Newton steps, lightly penalised."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return w


#: What offers pseudo-labels: (weights and calibration of both views, ids given to either) -> for either view (id, features of both views, label).
Offer = Callable[[list[np.ndarray], list[np.ndarray], list[set]], list[list[tuple]]]


def co_train(text: list[tuple], meta: list[tuple], y: np.ndarray, offer: Offer | None) -> Model:
    """Fits both views on half of the labelled rows (y) and on pseudo-labels, combines them on a quarter, and measures them on the last one."""
    part = mixed(np.arange(len(y), dtype=np.uint64), 4) % np.uint64(4)
    held, unseen, fit = part == 0, part == 1, part > 1
    pick = lambda rows, mask: [r for r, m in zip(rows, mask, strict=True) if m]
    views, sizes = (text, meta), (1 << TEXT_BITS, 1 << META_BITS)
    given: list[dict] = [{}, {}]  # what each view has been told: id -> (features of both views, label)

    def fitted(v: int) -> np.ndarray:
        told = [given[v][k] for k in sorted(given[v])]
        return _fit(pick(views[v], fit) + [f[v] for f, _ in told], np.concatenate([y[fit], np.array([float(c) for _, c in told])]), sizes[v])

    weights = [fitted(0), fitted(1)]
    for _ in range(ROUNDS if offer else 0):
        lines = [_line(_logits(pick(views[v], held), weights[v])[:, None], y[held]) for v in (0, 1)]
        for v, found in enumerate(offer(weights, lines, [set(given[1]), set(given[0])])):
            given[1 - v] |= {i: (f, c) for i, f, c in found}
        weights = [fitted(0), fitted(1)]
    logits = lambda mask: np.column_stack([_logits(pick(views[v], mask), weights[v]) for v in (0, 1)])
    a, b, c = _line(logits(held), y[held]).tolist()
    scored = lambda mask: 1 / (1 + np.exp(-np.clip(logits(mask) @ np.array([a, b]) + c, -500, 500)))
    p, good = scored(held), y[held] == 1
    threshold = 0.0
    if good.any():
        threshold = min(0.5, float(np.sort(p[good])[int(good.sum() * (1 - KEEP_GOOD))]))
        middle = float(np.median(p[~good])) if (~good).any() else 0.0
        if middle >= threshold and (p[good] > middle).mean() >= ENOUGH_GOOD:
            threshold = float(np.nextafter(middle, 1))
    kept, right = scored(unseen) >= threshold, y[unseen] == 1
    report = {"accuracy": float((kept == right).mean()), "good_kept": float(kept[right].mean()) if right.any() else 1.0, "bad_rejected": float((~kept[~right]).mean()) if (~right).any() else 1.0}
    return Model(weights[0], weights[1], (a, b, c), threshold, report)


_FEATURED = "doc_id long, slots binary, counts binary, meta array<int>"


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality); None unless both classes occur.

    Rows without id or label don't count. Of repeated ids the row with the least features serves, of repeated labels the least.
    """
    spark = docs.sparkSession
    lottery = F.xxhash64(F.lit(17), F.col("doc_id"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    labelled = {r["doc_id"]: r["quality"] for r in known.orderBy(lottery, "doc_id").limit(LABELLED).collect()}
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))

    def featured(ids: set[int]) -> dict[int, tuple]:
        """Features of few documents, by id."""
        wanted = F.broadcast(spark.createDataFrame([(i,) for i in sorted(ids)], "doc_id long"))
        found = rows.join(wanted, "doc_id").mapInArrow(_featured, _FEATURED).collect()
        ordered = sorted(found, key=lambda r: (r["doc_id"], bytes(r["slots"]), bytes(r["counts"]), r["meta"]), reverse=True)
        return {r["doc_id"]: ((np.frombuffer(r["slots"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["counts"], dtype=np.float32).astype(np.float64)), (np.array(r["meta"], dtype=np.int64), np.ones(3))) for r in ordered}

    of = featured(set(labelled))
    mine = sorted(i for i in labelled if i in of)
    y = np.array([float(labelled[i] > 0) for i in mine])
    if len(mine) < 8 or len(set(y.tolist())) < 2:
        return None

    def offer(weights: list[np.ndarray], lines: list[np.ndarray], told: list[set]) -> list[list[tuple]]:
        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                z = _both(weights, b.column(1).to_pylist(), zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True))
                p = [1 / (1 + np.exp(-np.clip(line[0] * x + line[1], -500, 500))) for x, line in zip(z, lines, strict=True)]
                says = [np.where(q >= SURE, 1, np.where(q <= 1 - SURE, 0, -1)) for q in p]
                some = np.flatnonzero((says[0] >= 0) | (says[1] >= 0))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *(pa.array(s[some].astype(np.int32)) for s in says)], names=["doc_id", "v0", "v1"])

        seen = stored(rows.mapInArrow(sure, "doc_id long, v0 int, v1 int").join(F.broadcast(spark.createDataFrame([(i,) for i in mine], "doc_id long")), "doc_id", "left_anti"), "pseudo-labels")
        drawn: list[dict[int, int]] = []
        for v in (0, 1):
            fresh = seen.where(F.col(f"v{v}") >= 0)
            if told[v]:
                fresh = fresh.where(~F.col("doc_id").isin(sorted(told[v])))
            once = [fresh.where(F.col(f"v{v}") == c).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(18), F.col("doc_id")), "doc_id").limit(EXCHANGED // 2).collect() for c in (0, 1)]
            drawn.append({r[0]: c for c, part in enumerate(once) for r in part})
        found = featured({*drawn[0], *drawn[1]})
        return [[(i, found[i], c) for i, c in sorted(drawn[v].items())] for v in (0, 1)]

    return co_train([of[i][0] for i in mine], [of[i][1] for i in mine], y, offer)


def _both(weights: list[np.ndarray], texts: list[str | None], metadata: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of both views for whole texts and their metadata."""
    z_text, z_meta = np.full(len(texts), weights[0][-1]), np.full(len(texts), weights[1][-1])
    for k, t in enumerate(texts):
        slots = text_slots(np.frombuffer((t or "").encode("utf-8", "replace"), dtype=np.uint8))
        if len(slots):
            z_text[k] += 30.0 * weights[0][slots].mean()
    for k, x in enumerate(metadata):
        z_meta[k] += weights[1][_meta_slots(*x)].sum()
    return z_text, z_meta


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the few documents that are fitted on, whole texts, so that texts don't go to the driver."""
    for b in sliced(batches):
        found = _text_features(b.column(1).to_pylist())
        meta = [_meta_slots(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.uint16).tobytes() for s, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "slots", "counts", "meta"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with p_text, p_meta, p_quality and keep added (columns of these names are replaced); a narrow pass over whole texts.

    A null or empty text has no trigrams, so its content says nothing; nulls in metadata are a value of their own.
    Without a model all documents are kept with p 1.
    """
    docs = docs.drop(*ADDED)
    names = docs.columns
    at = [names.index(x) for x in ("text", "source", "lang", "n_chars")]
    added = "p_text double, p_meta double, p_quality double, keep boolean"
    if model is None:
        return docs.select("*", *(F.lit(1.0).alias(x) for x in ADDED[:3]), F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for b in sliced(batches):
            z_text, z_meta = _both([model.text, model.meta], b.column(at[0]).to_pylist(), zip(*(b.column(c).to_pylist() for c in at[1:]), strict=True))
            a, c, bias = model.joint
            p = squash(a * z_text + c * z_meta + bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(squash(z_text)), pa.array(squash(z_meta)), pa.array(p), pa.array(p >= model.threshold)], names=[*names, *ADDED])

    return docs.mapInArrow(run, with_fields(docs, added))
