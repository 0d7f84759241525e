"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources they belong to). The flow network
has an arc from the start to each pattern for every pass over it (each as large as the pattern, and
dearer than the pass before: repetition costs are convex), arcs from a pattern to its sources, and
one from each source to the end, as large as its quota. Its min-cost flow says how many words of
which pattern serve which source. Passes that the flow fills take the whole pattern; of the last one
documents are chosen in the order of a seeded hash. A histogram of the hash finds where the choice
ends, first in coarse and then in fine bins, so no pattern is ever sorted in one task, and a few
closing documents per pattern, each with the size nearest to what is missing, mend the rest.

Null texts have size 0. A null source is a source of its own, last in order. Documents of no source
are never taken. Repeated rows have equal hashes: they are taken or left together. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from .frames import WORD, durable, prepared

REPEATS = 3
SEED = 17
BINS = 4096
#: Documents per pattern that mend what the bins leave missing.
CLOSING = 3
#: Patterns and sources are planned on the driver; more of them than this is an error.
MOST_PATTERNS = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: float = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, none above ``cap`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    wanted: dict[str | None, float] = {}
    open_sources, left = list(order), float(sum(sizes.values()))
    while open_sources:
        whole = sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if left * weight[s] / whole > cap * sizes[s]]
        if not full:
            wanted |= {s: left * weight[s] / whole for s in open_sources}
            break
        for s in full:
            wanted[s] = float(cap * sizes[s])
        left -= sum(wanted[s] for s in full)
        open_sources = [s for s in open_sources if s not in wanted]
    return wanted


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words to take of each pattern: a min-cost flow by successive cheapest paths."""
    graph: dict = defaultdict(dict)
    cost: dict = {}

    def arc(a, b, size, price) -> None:
        graph[a][b] = graph[a].get(b, 0) + size
        graph[b].setdefault(a, 0)
        cost[a, b], cost[b, a] = price, -price

    for p, size in patterns.items():
        for k in range(repeats):
            arc("start", ("pass", p, k), size, k)
            arc(("pass", p, k), ("pattern", p), size, 0)
        for s in p:
            arc(("pattern", p), ("source", s), repeats * size, 0)
    for s, quota in quotas.items():
        arc(("source", s), "end", quota, 0)
    potential: dict = defaultdict(int)
    while True:
        far, before, todo, tick = {"start": 0}, {}, [(0, 0, "start")], 0
        while todo:
            d, _, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for b, room in graph[a].items():
                new = d + cost[a, b] + potential[a] - potential[b]
                if room > 0 and new < far.get(b, float("inf")):
                    far[b], before[b], tick = new, a, tick + 1
                    heapq.heappush(todo, (new, tick, b))
        if "end" not in far:
            break
        for node, d in far.items():
            potential[node] += min(d, far["end"])
        for node in graph:
            if node not in far:
                potential[node] += far["end"]
        path, b = [], "end"
        while b != "start":
            path.append((before[b], b))
            b = before[b]
        room = min(graph[a][b] for a, b in path)
        for a, b in path:
            graph[a][b] -= room
            graph[b][a] += room
    return {p: sum(graph[("pass", p, k)].get("start", 0) for k in range(repeats)) for p in patterns}


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """All columns and, added or replaced, ``size``, ``members`` and ``h`` of each row."""
    return docs.withColumns({
        "size": word_count(), "members": F.array(F.col("source").cast("string")), "h": F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(seed)),
    })


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs`` (doc_id, text, source)."""
    rows, sizes, wanted, quotas = _quotas(docs, weights, repeats, seed)
    return select(rows, quotas, repeats).select(
        "doc_id", "size", _by_source(sizes, "long").alias("source_size"), _by_source(wanted, "double").alias("target"), "taken"
    )


def with_taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with ``size`` and ``taken``; ``members`` and ``h`` come too."""
    rows, _, _, quotas = _quotas(docs, weights, repeats, seed)
    return select(rows, quotas, repeats, wide=measured(docs, seed))


def _quotas(docs: DataFrame, weights: tuple[int, ...], repeats: int, seed: int):
    prepared(docs.sparkSession)
    rows = durable(measured(docs, seed).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", F.col("source").cast("string").alias("source"), "members", "h",
    ))
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()}
    wanted = targets(sizes, weights, repeats)
    return rows, sizes, wanted, {s: round(t) for s, t in wanted.items()}


def select(rows: DataFrame, quotas: dict, repeats: int = REPEATS, wide: DataFrame | None = None) -> DataFrame:
    """``rows`` (size, members, h and more) with ``taken``, so that sources meet their quotas.

    ``wide`` has the same rows with more columns: the choice is made on the narrow ``rows`` and then
    applied to ``wide`` with small broadcast tables, so whole texts are not shuffled.
    """
    found = _patterned(rows).groupBy("pattern").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["n"] for r in found}
    flow = route(patterns, quotas, repeats)
    plan = []  # pattern, whole passes, words of the last pass
    for p, n in patterns.items():
        passes = flow[p] // n if n else 0
        plan.append((list(p), int(passes), int(flow[p] - passes * n)))
    made = rows.sparkSession.createDataFrame(plan or [([], 0, 0)], "pattern array<string>, passes long, part long")
    # One row per pattern, at most MOST_PATTERNS: small enough for every machine.
    wanted = made.withColumn("__p", F.to_json(F.struct("pattern"))).drop("pattern")
    planned = _binned(rows, wanted)
    first = _ends(planned, "__c", F.col("part"))
    edge = planned.join(F.broadcast(first), "__p").where(F.col("__c") == F.col("__c_end"))
    second = _ends(edge, "__f", F.col("part") - F.col("__c_before"))
    ends = durable(first.join(second, "__p", "left"))
    chosen, closing = _placed(planned, ends), []
    for _ in range(CLOSING):
        closing.append(durable(_best(chosen)))
        chosen = _closed(chosen, closing[-1])
    out = rows
    if wide is not None:
        out, chosen = wide, _placed(_binned(wide, wanted), ends)
        for best in closing:
            chosen = _closed(chosen, best)
    taken = F.col("size") * (F.col("passes") + F.col("__in").cast("long"))
    return chosen.withColumn("taken", taken.cast("long")).select(*out.columns, "taken")


def _patterned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pattern", F.array_sort(F.array_distinct("members")))


def _binned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    planned = _patterned(rows).withColumn("__p", F.to_json(F.struct("pattern"))).join(F.broadcast(wanted), "__p")
    coarse, fine = F.pmod("h", F.lit(BINS)), F.pmod(F.floor(F.col("h") / BINS), F.lit(BINS))
    return planned.withColumn("__c", coarse).withColumn("__f", fine)


def _placed(planned: DataFrame, ends: DataFrame) -> DataFrame:
    """Whether a row comes before the end of its pattern's choice, and what that leaves missing."""
    before = (F.col("__c") < F.col("__c_end")) | ((F.col("__c") == F.col("__c_end")) & (F.col("__f") < F.col("__f_end")))
    missing = F.col("part") - F.col("__c_before") - F.coalesce("__f_before", F.lit(0))
    placed = planned.join(F.broadcast(ends), "__p")  # one row per pattern at most
    return placed.withColumn("__in", F.coalesce(before, F.lit(False))).withColumn("__missing", missing)


def _best(chosen: DataFrame) -> DataFrame:
    """Of each pattern the document that would leave the least missing."""
    off = F.abs(F.col("__missing") - F.col("size"))
    return (
        chosen.where(~F.col("__in") & (F.col("size") > 0) & (off < F.col("__missing")))
        .groupBy("__p").agg(F.min(F.struct(off.alias("off"), F.col("h").alias("h"), F.col("size").alias("size"))).alias("best"))
        .select("__p", F.col("best.h").alias("__h"), F.col("best.size").alias("__size"))
    )


def _closed(chosen: DataFrame, best: DataFrame) -> DataFrame:
    done = chosen.join(F.broadcast(best), "__p", "left")  # one row per pattern at most
    last = F.coalesce((F.col("h") == F.col("__h")) & (F.col("size") == F.col("__size")), F.lit(False))
    return (
        done.withColumn("__in", F.col("__in") | last)
        .withColumn("__missing", F.col("__missing") - F.coalesce("__size", F.lit(0))).drop("__h", "__size")
    )


def _ends(rows: DataFrame, bin_column: str, wanted: Column) -> DataFrame:
    """Per pattern the bin in which the running sum passes ``wanted``, and the sum before it."""
    from pyspark.sql import Window as W

    bins = rows.groupBy("__p", bin_column).agg(F.sum("size").alias("n"), F.first(wanted).alias("wanted"))
    until = F.sum("n").over(W.partitionBy("__p").orderBy(bin_column))  # at most BINS rows
    return (
        bins.withColumn("until", until).where(F.col("until") > F.col("wanted"))
        .groupBy("__p").agg(F.min(F.struct(bin_column, (F.col("until") - F.col("n")).alias("before"))).alias("end"))
        .select("__p", F.col(f"end.{bin_column}").alias(f"{bin_column}_end"), F.col("end.before").alias(f"{bin_column}_before"))
    )


def _by_source(values: dict, kind: str) -> Column:
    """The value of a row's source. One entry per source, as many as the plan holds."""
    named = [x for s, v in values.items() if s is not None for x in (F.lit(s), F.lit(v))]
    found = F.create_map(*named)[F.col("source")] if named else F.lit(None)
    return F.when(F.col("source").isNull(), F.lit(values.get(None))).otherwise(found).cast(kind)
