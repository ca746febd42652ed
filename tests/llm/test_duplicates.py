import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roiforge.llm import common, embeddings, jaccard
from roiforge.llm.common import block_tasks, components, forest, spread_tasks
from roiforge.llm.fingerprint import canonical, edits_and_neighbours, exact_groups, fingerprints
from roiforge.llm.jaccard import jaccard_components, jaccard_links, shingle_sets


def united(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 340)] + [(500, 500 + k) for k in range(1, 60)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == united(nodes, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    a, b = np.array([5, 7, 9, 1]), np.array([7, 9, 5, 2])
    u, v = forest(a, b)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(2, 1), (7, 5), (9, 5)]


def brute_jaccard(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in united(ids, links).items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, words, percent):
    rng = np.random.default_rng(percent)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "A", "a"]
    passage = " ".join(rng.choice(vocabulary, 40))
    rows = [(0, None), (1, ""), (2, " \t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a " * 500)]
    for _ in range(60):
        text = list(rng.choice(vocabulary, int(rng.integers(1, 250))))
        for _ in range(int(rng.integers(1, 6))):
            copy = list(text)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(copy) + (" " + passage if rng.random() < 0.3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as part", "'y' as digest", "0 as head")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, words, percent).collect()}
    assert found == brute_jaccard(rows, words, percent)


def near_texts(rng, n=25, copies=4):
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(n):
        text = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        for _ in range(copies):
            other = list(text)
            for _ in range(int(rng.integers(0, 3))):
                other[int(rng.integers(len(other)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(other)))
    return rows


def test_number_of_links_and_blocks(spark, monkeypatch):
    """All links are counted, whichever way the blocks of large groups get their counts."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = near_texts(np.random.default_rng(12)) + [(1000 + k, "the same text of seven words here") for k in range(9)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if (w := (t or "").split()) else set() for i, t in rows}
    links = {i: sum(j != i and bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    want = brute_jaccard(rows, 3, 90)
    for most, hub in ((100_000, 500), (0, 2)):
        monkeypatch.setattr(common, "MOST_WIDE", most)
        monkeypatch.setattr(jaccard, "HUB", hub)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_links(df).collect()}
        assert found == {i: (*want[i], links[i]) for i in links}


def test_prefixes_under_every_order_are_intersected():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(4)]
    near = np.sort(np.concatenate([sets[0][:-2], rng.integers(0, 1 << 62, 2, dtype=np.uint64)]))
    far = np.sort(np.concatenate([sets[1][:10], rng.integers(0, 1 << 62, 50, dtype=np.uint64)]))
    a, b = jaccard.verified_links([*sets, near, far], np.zeros(6), True, 90)
    assert {frozenset(p) for p in zip(a, b, strict=True)} == {frozenset((0, 4))}
    for order in jaccard.ORDERS:
        assert not jaccard._first(sets[0], order, 90).isdisjoint(jaccard._first(near, order, 90))


def test_blocks_of_a_large_group_are_spread(spark):
    rows = spark.range(3000).selectExpr("id as rep", "if(id < 2900, 0, id) as part", "0 as role")
    tasks = block_tasks(rows, ["part"], ["rep"], 100)
    assert tasks.select("part", "x", "i").distinct().count() == 29 * 30 // 2
    plan = spread_tasks(tasks, ["part"]).groupBy("part", "x", "i").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and any("part" in line and "x#" in line and "i#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    pairs = tasks.alias("p").join(tasks.alias("q"), ["part", "x", "i"]).where("p.rep < q.rep and (x = i or p.side <> q.side)").count()
    assert pairs == 2900 * 2899 // 2


def test_folders_and_settings_are_left_as_they_were(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    jaccard_components(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert common.forget_folders(spark) > 0 and common.forget_folders(spark) == 0


def test_jaccard_join_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "x y z"), (9, "x y z")]
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_do_not_span_texts():
    a, b = shingle_sets(pa.array(["a b c", "c d e"]), 3)
    assert len(a) == len(b) == 1 and a[0] != b[0] and shingle_sets(pa.array(["A B\tC"]), 3)[0][0] == a[0]


def vectors(rng, n=120, dim=16):
    base = rng.normal(size=(n, dim))
    near = base[:40] + rng.normal(scale=0.04, size=(40, dim))
    chain = [base[0]]
    for _ in range(10):
        chain.append(chain[-1] + rng.normal(scale=0.04, size=dim))
    return np.concatenate([base, near, np.array(chain), np.repeat(base[:1], 9, axis=0), base[1:3] * 5]).astype(np.float32)


def test_vector_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    monkeypatch.setattr(embeddings, "CELL", 4)
    v = vectors(np.random.default_rng(2))
    labels = [int(k % 2) for k in range(len(v))]
    rows = [(k, x.tolist(), y) for k, (x, y) in enumerate(zip(v, labels, strict=True))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, v[0].tolist(), None), (1004, [1.0, None], 0), (1005, [], 0), (1006, [2.0, 1.0], 0), (1007, [4.0, 2.0], 0), (1008, [3.0], 1), (1009, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as rep", "1 as dim", "2 as h")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(close, False)
    parts = united(range(len(v)), [(int(a), int(b)) for a, b in zip(*np.nonzero(close), strict=True)])
    want = {k: (int(close[k].sum()), parts[k], parts[k] == k) for k in range(len(v))}
    want |= {i: (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008, 1009)} | {1006: (1, 1006, True), 1007: (1, 1006, False)}
    assert found == want
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(30), rng.random(20)
    pairs = list(embeddings.multi_sequence(a, b, 1.1))
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums) and len(set(pairs)) == len(pairs) == (a[:, None] + b[None] <= 1.1).sum()
    assert list(embeddings.multi_sequence(a, b, -1)) == []


@pytest.mark.parametrize("dim", [16, 64])
def test_recall_of_a_shorter_visit(spark, dim):
    """The calibrated visit finds the share of linked pairs that it promises, measured against brute force, and visits fewer cells."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, dim))
    v = np.concatenate([base, base + rng.normal(scale=0.17 / dim**0.5, size=base.shape) * np.linalg.norm(base, axis=1, keepdims=True)])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    half = dim // 2
    books = embeddings.codebook(u[:2000, :half], 12), embeddings.codebook(u[:2000, half:], 12, seed=6)
    short, whole = (embeddings._reach(u[:2000], books, 0.98, t) for t in (0.99, 1.0))
    cells = [sum(map(len, embeddings.visited(u[:500], books, r)[1])) for r in (short, whole)]
    assert whole == pytest.approx(0.2) and cells[0] < cells[1]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    exact = np.triu(u @ u.T >= 0.98, 1).sum()
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(u)], "vec_id long, embedding array<double>, label int")
    found = embeddings.near_duplicates(df, target_recall=0.99).agg({"n_links": "sum"}).first()[0] / 2
    assert exact > 500 and 0.985 * exact <= found <= exact


def test_canonical_texts():
    assert canonical("Ａb  C\n") == b"ab c" and canonical("é") == canonical("é") and canonical("Straße") == canonical("STRASSE") and canonical(None) == canonical(" ") == b""
    for text in ("İİ", "ῃͅ", "ﬃ X"):
        once = canonical(text).decode()
        assert canonical(once).decode() == once and unicodedata.is_normalized("NFKC", once)


def test_exact_groups(spark):
    rows = [(k, "Hot  text") for k in range(50)] + [(100, "hot text"), (101, None), (102, ""), (103, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as copies")
    found = {r["doc_id"]: (r["group_id"], r["copies"]) for r in exact_groups(df).collect()}
    assert found[100] == (0, 51) and found[101] == found[102] == (101, 2) and found[103] == (103, 1)
    assert fingerprints(df).where("doc_id = 100").first()["fingerprint"] == fingerprints(df).where("doc_id = 0").first()["fingerprint"]


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    """With a digest that knows lengths only, groups are those of equal bytes all the same."""
    from roiforge.llm import fingerprint

    table = fingerprint._with_bytes(spark.createDataFrame([(1, "aa"), (2, "AA"), (3, "bb"), (4, "ccc"), (5, None), (None, "bb")], "doc_id long, text string"))
    coarse = table.withColumn("fingerprint", F.length("bytes").cast("string"))
    monkeypatch.setattr(fingerprint, "_with_bytes", lambda docs: coarse)
    found = {(r["doc_id"], r["group_id"], r["copies"]) for r in fingerprint.exact_groups(None).collect()}
    assert found == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (None, 3, 2), (4, 4, 1), (5, 5, 1)}


def test_edits_of_repeats_nulls_and_long_texts(spark):
    """Against brute force, over more partitions than rows; clashing columns are ignored."""
    import hashlib

    rows = [(7, "Straße " * 4000), (7, "abc"), (None, "x"), (12, "é" * 30_001), (30, None), (31, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'a' as fingerprint", "2 as last", "'q' as near_next")
    found = sorted(((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"], r["near_next"]) for r in edits_and_neighbours(df).collect()))
    ordered = sorted(((i if i is not None else -1, t or "") for i, t in rows))
    want = []
    for k, (i, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(after))))
    assert found == sorted(want)


def test_neighbours_wrap_around(spark):
    rows = [(5, "abcd"), (9, "ABCD"), (11, None), (40, "wxyzé!")]
    found = {r["doc_id"]: r for r in edits_and_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[5]["near_next"] == 1 and found[9]["near_next"] == 0 and [found[k]["n_chars"] for k in (5, 9, 11, 40)] == [4, 4, 0, 6]
    import hashlib

    assert found[40]["edited_sha256"] == hashlib.sha256(b"wxyabc").hexdigest() and found[9]["edited_sha256"] == hashlib.sha256(b"AB").hexdigest()
    one = edits_and_neighbours(spark.createDataFrame([(1, "aa")], "doc_id long, text string")).first()
    assert one["near_edited"] == one["near_next"] == 1
    assert edits_and_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
