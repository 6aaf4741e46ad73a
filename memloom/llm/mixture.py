"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they count for). Each pattern
offers its words in passes: the first is free, each further one dearer (convex repetition costs).
A min-cost flow routes the patterns' words to the sources' quotas, and each pattern's flow becomes
whole passes plus a seeded share of its documents.

The share is cut at a point of a seeded 63-bit order: a hash of id and text, then one of the row's
place, so that a run of equal rows can be cut within. The point is found by histograms of 12 leading
bits after 12, until a bucket holds a single row. They are aggregated before they are shuffled and
summed up in two steps of 64 buckets, so that no task or driver ever holds the documents of a source.
What the first document beyond the cut leaves open is filled by further steps over smaller documents.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; of rows
that repeat both id and text any may be the ones that are taken; sources without words get target
0; an empty table gives an empty result; columns beyond those named are never read by name.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_REGEX, Scratch

SEED = 20240701
MAX_REPEATS = 3
#: Cost of a word in its first, second and third pass.
PASS_COSTS = (0, 1, 3)
#: Patterns (and sources) that the driver's flow network may have; the size bound of the broadcast.
MAX_PATTERNS = 100_000
#: Histogram levels and their bits; what they leave of the order is 8 neighbouring places.
_BITS = 12
_LEVELS = 5
#: Low bits of the order that tell equal rows apart.
_SPREAD = (1 << 24) - 1
#: Times that what a too large document leaves open is filled with smaller ones.
_STEPS = 4
_TOP = (1 << 63) - 1


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def seeded(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A place in [0, 2**63) that orders rows for selection; equal rows get different ones."""
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).bitwiseAND(F.lit(_SPREAD))
    return F.xxhash64(F.lit(seed), doc_id, text).bitwiseAND(F.lit(_TOP - _SPREAD)).bitwiseOR(place)


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Each source's quota: its weight's share of all words, at most `most` times its own size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest, out = float(sum(sizes.values())), list(order), {}
    while rest:
        total = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        rest = [s for s in rest if s not in out]
    return out


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Min-cost flow by potentials; all shortest paths of one cost are filled at once, level by level.
    Costs are not negative."""

    def __init__(self, nodes: int):
        self.edges: list[list[_Edge]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.edges[a].append(_Edge(b, room, cost, len(self.edges[b])))
        self.edges[b].append(_Edge(a, 0, -cost, len(self.edges[a]) - 1))
        return a, len(self.edges[a]) - 1

    def run(self, start: int, end: int) -> int:
        n, sent = len(self.edges), 0
        height = [0] * n
        while True:
            far = self._distances(start, height)
            if far[end] is None:
                return sent
            height = [h + (far[end] if f is None else min(f, far[end])) for h, f in zip(height, far, strict=True)]
            while (level := self._levels(start, end, height)) is not None:
                sent += self._fill(start, end, height, level)

    def _distances(self, start: int, height: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.edges)
        far[start], queue = 0, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in self.edges[a]:
                if e.room:
                    there = d + e.cost + height[a] - height[e.to]
                    if far[e.to] is None or there < far[e.to]:
                        far[e.to] = there
                        heapq.heappush(queue, (there, e.to))
        return far

    def _levels(self, start: int, end: int, height: list[int]) -> list[int] | None:
        """Steps from the start over edges on shortest paths, or None if the end is not reached."""
        level = [-1] * len(self.edges)
        level[start], queue = 0, deque([start])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if e.room and level[e.to] < 0 and e.cost + height[a] == height[e.to]:
                    level[e.to] = level[a] + 1
                    queue.append(e.to)
        return level if level[end] >= 0 else None

    def _fill(self, start: int, end: int, height: list[int], level: list[int]) -> int:
        """Sends what fits along paths that go up one level a step; no edge is tried twice in vain."""
        following, sent = [0] * len(self.edges), 0
        path: list[_Edge] = []
        at = start
        while True:
            if at == end:
                push = min(e.room for e in path)
                for e in path:
                    e.room -= push
                    self.edges[e.to][e.back].room += push
                sent += push
                path, at = [], start
                continue
            edges = self.edges[at]
            while following[at] < len(edges):
                e = edges[following[at]]
                if e.room and level[e.to] == level[at] + 1 and e.cost + height[at] == height[e.to]:
                    break
                following[at] += 1
            else:
                if at == start:
                    return sent
                gone = path.pop()
                at = self.edges[gone.to][gone.back].to
                following[at] += 1
                continue
            path.append(e)
            at = e.to


def route(patterns: dict[tuple, int], quotas: dict[str | None, float], costs: tuple[int, ...] = PASS_COSTS) -> dict[tuple, int]:
    """Words that each pattern sends in all, repeats counted."""
    keys, sources = list(patterns), list(quotas)
    net = FlowNetwork(len(keys) + len(sources) + 2)
    start, end = len(keys) + len(sources), len(keys) + len(sources) + 1
    where = {s: len(keys) + i for i, s in enumerate(sources)}
    offered = {}
    for i, key in enumerate(keys):
        offered[key] = [net.add(start, i, patterns[key], cost) for cost in costs]
        for s in key:
            net.add(i, where[s], len(costs) * patterns[key], 0)
    for s, quota in quotas.items():
        net.add(where[s], end, round(quota), 0)
    net.run(start, end)
    return {key: sum(patterns[key] - net.edges[a][i].room for a, i in arcs) for key, arcs in offered.items()}


def _reach(parts: Column, found: Column, rest: Column) -> Column:
    """Of buckets (at, words, ...) in order: the first at which the words in front and its own pass the
    rest (or -1), and the words in front of it."""
    none = F.struct(F.lit(-1).cast("long").alias("at"), found.alias("found"))

    def step(seen: Column, part: Column) -> Column:
        upto = seen["found"] + part["words"]
        over = F.struct(part["at"].alias("at"), seen["found"].alias("found"))
        on = F.struct(F.lit(-1).cast("long").alias("at"), upto.alias("found"))
        return F.when(seen["at"] >= 0, seen).when(upto > rest, over).otherwise(on)

    return F.aggregate(F.array_sort(parts), none, step)


def _first_over(spark: SparkSession, sized: DataFrame, state: list[tuple]) -> dict[tuple, tuple[int, int]]:
    """Per pattern, the place at which the words of its fitting documents first pass the rest.

    `state` has rows (members, start, rest): only documents no larger than the rest, at places from
    `start` on, count. Gives (cut, words in front of the cut); the cut is 2**63 - 1 if all fit.
    """
    schema = "members array<string>, start long, rest long, low long, found long"
    at = [(*row, 0, 0) for row in state]
    done: dict[tuple, tuple[int, int]] = {}
    for level in range(_LEVELS):
        plan = F.broadcast(spark.createDataFrame(at, schema))  # bounded by MAX_PATTERNS
        shift = 63 - _BITS * (level + 1)
        # 64 times 64 buckets a pattern at most, each with its words, rows and first place
        fine = (
            sized.join(plan, "members")
            .where((F.shiftright("pick", shift + _BITS) == F.col("low")) & (F.col("pick") >= F.col("start")) & (F.col("size") <= F.col("rest")))
            .groupBy("members", "rest", "found", F.shiftright("pick", shift).alias("at"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("pick").alias("first"))
        )
        coarse = fine.groupBy("members", "rest", "found", F.shiftright("at", _BITS // 2).alias("above")).agg(
            F.sum("words").alias("words"), F.collect_list(F.struct("at", "words", "n", "first")).alias("parts")
        )
        whole = coarse.groupBy("members", "rest", "found").agg(F.collect_list(F.struct(F.col("above").alias("at"), "words", "parts")).alias("all"))
        outer = whole.withColumn("outer", _reach(F.col("all"), F.col("found"), F.col("rest")))
        chosen = F.get(F.filter("all", lambda x: x["at"] == F.col("outer.at")), F.lit(0))["parts"]
        inner = outer.withColumn("parts", chosen).withColumn("inner", F.when(F.col("outer.at") >= 0, _reach(F.col("parts"), F.col("outer.found"), F.col("rest"))))
        hit = F.get(F.filter("parts", lambda x: x["at"] == F.col("inner.at")), F.lit(0))
        hits = inner.select("members", F.coalesce("inner.found", "outer.found").alias("words"), hit.alias("hit")).collect()  # a row a pattern
        opened = {tuple(r["members"]): r for r in hits}
        following = []
        for members, start, rest, _, found in at:
            r = opened.get(tuple(members))
            if r is None or r["hit"] is None:
                done[tuple(members)] = (_TOP, int(r["words"]) if r else found)
            elif r["hit"]["n"] == 1 or level == _LEVELS - 1:
                done[tuple(members)] = (int(r["hit"]["first"]), int(r["words"]))
            else:
                following.append((members, start, rest, int(r["hit"]["at"]), int(r["words"])))
        at = following
        if not at:
            break
    return done


def plan_mix(spark: SparkSession, sized: DataFrame) -> DataFrame:
    """From rows (members, size, pick): per pattern its whole passes, and the steps of its seeded share.

    A step takes the documents in their order that are no larger than what is missing, up to the
    first that would pass it; later steps fill what that one left. `sized` is read once a histogram
    level and should be a written table.
    """
    grouped = sized.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(grouped) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge rare sources first")
    patterns = {tuple(r["members"]): int(r["size"]) for r in grouped}
    by_source: dict[str | None, int] = {}
    for key, size in patterns.items():
        for s in key:
            by_source[s] = by_source.get(s, 0) + size
    quotas = targets(by_source)
    sent = route(patterns, quotas)
    steps: dict[tuple, list] = {key: [] for key in patterns}
    state = [(list(key), 0, sent[key] % size) for key, size in patterns.items() if size and sent[key] % size]
    for _ in range(_STEPS):
        if not state:
            break
        cuts = _first_over(spark, sized, state)
        following = []
        for members, start, rest in state:
            cut, words = cuts[tuple(members)]
            steps[tuple(members)].append((start, cut, rest))
            if cut < _TOP and rest > words:
                following.append((members, cut, rest - words))
        state = following
    rows = [
        (list(key), int(sent[key] // size) if size else 0, steps[key], by_source.get(key[0], 0) if key else 0, quotas.get(key[0], 0.0) if key else 0.0)
        for key, size in patterns.items()
    ]
    return spark.createDataFrame(rows, "members array<string>, passes int, steps array<struct<start:long,cut:long,fits:long>>, source_size long, target double")


def taken_words() -> Column:
    """Of a row with pick and size, joined to its pattern's plan."""
    inside = F.exists("steps", lambda s: (F.col("pick") >= s["start"]) & (F.col("pick") < s["cut"]) & (F.col("size") <= s["fits"]))
    return (F.col("size") * (F.col("passes") + inside.cast("int"))).cast("long")


def mix(spark: SparkSession, docs: DataFrame, seed: int = SEED, members: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    `members` is the array of the sources that a document counts for, its own alone by default;
    source_size and target are those of the first.
    """
    scratch = Scratch(spark, "mix")
    sized = scratch.put(
        docs.select(
            "doc_id",
            (F.array(F.col("source").cast("string")) if members is None else members).alias("members"),
            size_of(F.col("text")).alias("size"),
            seeded(F.col("doc_id"), F.col("text"), seed).alias("pick"),
        ),
        "sized",
    )
    plan = plan_mix(spark, sized)
    return sized.join(F.broadcast(plan), "members").select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Pipeline form: the documents that the mix takes, with their columns, then size, source_size,
    target and taken. A column of that name in `docs` is replaced."""
    scratch = Scratch(spark, "mix")
    extra = ("size", "source_size", "target", "taken")
    columns = [c for c in docs.columns if c.lower() not in extra]
    packed = docs.select(
        F.struct(*columns).alias("row"),
        F.array(F.col("source").cast("string")).alias("members"),
        size_of(F.col("text")).alias("size"),
        seeded(F.col("doc_id"), F.col("text"), seed).alias("pick"),
    )
    sized = scratch.put(packed.drop("row"), "sized")
    plan = plan_mix(spark, sized)
    return (
        packed.join(F.broadcast(plan), "members")
        .withColumn("taken", taken_words())
        .where(F.col("taken") > 0)
        .select("row.*", *extra)
    )
