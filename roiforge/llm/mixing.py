"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources they belong to). Word capacity flows from patterns to
source quotas at least cost, each further pass over a pattern costing more than the one before (convex repetition
costs). A pattern's flow then fixes how often its documents are taken: all of them e times, and one more time those that come first
in a seeded order, as far as the remaining words go. That order is by buckets of the hash, the bucket in which the words run out is
dealt to buckets again while it holds many documents, and so on; of the last one's documents the first by hash are taken
and then, largest first, whichever still fit. So the driver holds a few numbers for each pattern, and every document counts.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roiforge.llm.common import stored

#: Costs of a pattern's first, second and third pass; no more passes are made.
PASS_COSTS = (0, 1, 3)
#: Buckets to which a pattern's documents are dealt in one round, at most; documents meant for each, and so many that a last one may hold.
BUCKETS, BUCKET_DOCS, LAST_DOCS = 4096, 64, 1024
#: Patterns are planned on the driver; more than this many is an error.
MOST_PATTERNS = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: list[tuple[str | None, int]], most_passes: int = len(PASS_COSTS)) -> dict[str | None, float]:
    """Targets of sources: by code point, null last, they weigh 1, 2, 3, repeating, and share the sum of all sizes.

    A target stops at most_passes times its source's size; the excess is shared anew by weight until none is above.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: k % 3 + 1 for k, (s, _) in enumerate(ordered)}
    most = {s: most_passes * n for s, n in ordered}
    target: dict[str | None, float] = {}
    rest, active = float(sum(n for _, n in ordered)), [s for s, _ in ordered]
    while active:
        unit = rest / sum(weight[s] for s in active)
        above = [s for s in active if unit * weight[s] > most[s]]
        if not above:
            return target | {s: unit * weight[s] for s in active}
        for s in above:
            target[s] = float(most[s])
            rest -= most[s]
        active = [s for s in active if s not in target]
    return target


def route(capacity: dict, members: dict, quota: dict) -> dict:
    """Min-cost max-flow: capacity of each pattern's pass, its member sources, quotas in words -> words taken by pattern.

    Successive shortest paths with potentials; costs are those of passes. Integer capacities give integer flows.
    """
    names = ["S", "T", *(("p", p) for p in capacity), *(("s", s) for s in quota)]
    at = {x: k for k, x in enumerate(names)}
    graph: list[list[list]] = [[] for _ in names]

    def arc(a, b, room: int, cost: int) -> None:
        graph[at[a]].append([at[b], room, cost, len(graph[at[b]])])
        graph[at[b]].append([at[a], 0, -cost, len(graph[at[a]]) - 1])

    total = sum(quota.values())
    for p, room in capacity.items():
        for cost in PASS_COSTS:
            arc("S", ("p", p), room, cost)
        for s in members[p]:
            arc(("p", p), ("s", s), total, 0)
    for s, q in quota.items():
        arc(("s", s), "T", q, 0)
    potential = [0] * len(names)
    while True:
        far, come = [float("inf")] * len(names), [None] * len(names)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            for k, (w, room, cost, _) in enumerate(graph[v]):
                if room > 0 and (e := d + cost + potential[v] - potential[w]) < far[w]:
                    far[w], come[w] = e, (v, k)
                    heapq.heappush(queue, (e, w))
        if far[1] == float("inf"):
            break
        potential = [p + min(f, far[1]) for p, f in zip(potential, far, strict=True)]
        path, v = [], 1
        while v:
            u, k = come[v]
            path.append(graph[u][k])
            v = u
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            graph[e[0]][e[3]][1] += room
    return {p: sum(graph[e[0]][e[3]][1] for e in graph[at["S"]] if e[0] == at[("p", p)]) for p in capacity}


class Mix(NamedTuple):
    """plan: one row a pattern (pattern, passes, levels: the buckets and the last one taken up to, cut); fillers: pattern, hash of documents
    taken beyond the cut; targets: by source; sized: doc_id, pattern, members, size, hash; source_sizes."""

    plan: DataFrame
    fillers: DataFrame
    targets: dict
    sized: DataFrame
    source_sizes: dict


_PLAN = "pattern string, passes long, levels array<struct<buckets:long,edge:long>>"


def _hash(pattern: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), pattern, F.col("text"))


def _bucket(level: int, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col("hash")), buckets)


def plan_mix(docs: DataFrame, sources: Column | None = None, quotas: dict | None = None, seed: int = 20) -> Mix:
    """Plans a mix of docs (doc_id, text and a source).

    sources: a column array<string> of the sources of each document (overlapping sources), by default the array of source
    alone; a null source is a source of its own. quotas: words by source, by default those of shares(). No
    document is taken more often than there are passes. Null texts have no words. Rows equal in id, source and text share a hash and are
    taken together; rows that only share an id (a null one, say) are not. An empty table gives an empty plan. The driver gets a few
    numbers for each pattern and for each source.
    """
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(sources)) if sources is not None else F.array(F.col("source"))
    key = F.to_json(F.struct(pattern.alias("s")), {"ignoreNullFields": "false"})
    sized = stored(docs.select(F.col("doc_id").cast("long"), key.alias("pattern"), pattern.alias("members"), words_in(F.col("text")).alias("size"), _hash(key, seed).alias("hash")), "sizes")
    totals = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    source_sizes: dict = {}
    for r in totals:
        for s in r["members"]:
            source_sizes[s] = source_sizes.get(s, 0) + r["size"]
    targets = quotas if quotas is not None else shares(list(source_sizes.items()))
    flow = route({r["pattern"]: r["size"] for r in totals}, {r["pattern"]: r["members"] for r in totals}, {s: round(t) for s, t in targets.items()})
    passes = {r["pattern"]: divmod(flow[r["pattern"]], r["size"]) if r["size"] else (0, 0) for r in totals}
    levels: dict[str, list[tuple[int, int]]] = {p: [] for p in passes}
    left = {p: rest for p, (_, rest) in passes.items() if rest}
    open_ = {r["pattern"]: r["n"] for r in totals if r["pattern"] in left}
    for level in range(16):
        edges = _edges(sized, level, levels, {p: (left[p], n) for p, n in open_.items()})
        now = {}
        for p, (buckets, edge, rest, n) in edges.items():
            levels[p].append((buckets, edge))
            left[p] = rest
            # equal rows can't be dealt further
            if n > LAST_DOCS and n < open_[p]:
                now[p] = n
        open_ = now
        if not open_:
            break
    plan = spark.createDataFrame([(p, e, levels[p]) for p, (e, _) in passes.items()], _PLAN)
    last = _within(sized, plan).where("at = 0").join(F.broadcast(spark.createDataFrame(list(left.items()), "pattern string, left long")), "pattern")
    units = last.groupBy("pattern", "left", "hash").agg(F.sum("size").alias("size"))

    def fill(group):
        import pandas as pd

        group = group.sort_values("hash")
        left, sizes, hashes = int(group["left"].iloc[0]), group["size"].tolist(), group["hash"].tolist()
        k = 0
        while k < len(sizes) and sizes[k] <= left:
            left -= sizes[k]
            k += 1
        more = []
        for n, h in sorted(zip(sizes[k:], hashes[k:], strict=True), reverse=True):
            if 0 < n <= left:
                left -= n
                more.append(h)
        taken = hashes[:k] + more
        return pd.DataFrame({"pattern": pd.Series([group["pattern"].iloc[0]] * len(taken), dtype=object), "hash": pd.Series(taken, dtype="int64")})

    fillers = stored(units.groupBy("pattern").applyInPandas(fill, "pattern string, hash long"), "mix-fillers")
    return Mix(plan, fillers, targets, sized, source_sizes)


def _edges(sized: DataFrame, level: int, levels: dict, open_: dict) -> dict:
    """For open patterns (words left, documents in the bucket dealt last) the next deal: buckets, the one in which the words run out, words left in it, its documents."""
    if not open_:
        return {}
    spark = sized.sparkSession
    rows = [(p, levels[p], left, max(1, min(BUCKETS, n // BUCKET_DOCS))) for p, (left, n) in open_.items()]
    told = F.broadcast(spark.createDataFrame(rows, "pattern string, levels array<struct<buckets:long,edge:long>>, left long, buckets long"))
    inside = sized.join(told, "pattern")
    for k in range(level):
        inside = inside.where(_bucket(k, F.col("levels")[k]["buckets"]) == F.col("levels")[k]["edge"])
    sums = inside.withColumn("bucket", _bucket(level, F.col("buckets"))).groupBy("pattern", "buckets", "left", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sums.withColumn("before", before).where("before <= left and before + size > left").collect()
    return {r["pattern"]: (r["buckets"], r["bucket"], r["left"] - r["before"], r["n"]) for r in found}


def _within(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (pattern, hash, ...) with passes and at: -1 where a row comes before the last bucket of its pattern, 0 in it, 1 after it; null where its pattern is taken by whole passes."""
    joined = rows.join(F.broadcast(plan), "pattern")
    most = plan.agg(F.max(F.size("levels"))).first()[0] or 0
    at = F.when(F.size("levels") > 0, F.lit(0))
    for k in reversed(range(most)):
        step = _bucket(k, F.get("levels", F.lit(k))["buckets"])
        edge = F.get("levels", F.lit(k))["edge"]
        at = F.when(step < edge, -1).when(step > edge, 1).otherwise(at)
    return joined.withColumn("at", at).drop("levels")


def copies_of(mix: Mix, rows: DataFrame) -> DataFrame:
    """rows (pattern, hash, ...) with copies int: how often the mix takes each row.

    The plan has a row for each pattern, at most MOST_PATTERNS of a few numbers, and is broadcast; the fillers, LAST_DOCS a pattern at most, are not unless they are few.
    """
    joined = _within(rows, mix.plan).join(mix.fillers.withColumn("filler", F.lit(True)), ["pattern", "hash"], "left")
    chosen = F.coalesce((F.col("at") < 0) | F.coalesce(F.col("filler"), F.lit(False)), F.lit(False))
    return joined.withColumn("copies", (F.col("passes") + chosen.cast("int")).cast("int")).drop("passes", "at", "filler")


def mixed_documents(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of docs."""
    mix = plan_mix(docs, seed=seed)
    key = F.to_json(F.struct(F.array(F.col("source")).alias("s")), {"ignoreNullFields": "false"})
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("pattern"), _hash(key, seed).alias("hash"))
    return copies_of(mix, whole).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
