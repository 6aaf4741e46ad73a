"""Near duplicates by 64-bit SimHash and a Gray-order hierarchical index.

Fingerprints at 3 or fewer differing bits agree in one of four 16-bit blocks, so each distinct
fingerprint is dealt to four groups (block, value). Groups with more than GROUP_ROWS members are
dealt anew by a quarter of their free bits, level by level; what is still larger after the last
level is cut into slices and every pair of slices is a group of its own. In a group the index sorts
the fingerprints by Gray rank and puts runs of FANOUT under a node that keeps the bits all of them
share (mask and pattern), less those its parent already has. A search carries the differences from
node to node and leaves a whole subtree once they pass the threshold.

Groups return a spanning forest of their links, not all pairs; components follow by alternating
large and small stars over written edge tables.

Defined results: ids may be of any type that can be ordered; a null or blank text has fingerprint zero, linked like any other; rows that repeat
an id share its component; a null id never names a component (a component of null ids only has a
null name) and sorts behind all ids where one row of a component is kept; an empty table gives an
empty result; only the id and text columns are read by name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, texts_of

SHINGLE = 3
SEED = 42
DISTANCE = 3
GROUP_ROWS = 1024
FANOUT = 8
#: Rows of whole groups that a task indexes at once.
RUN_ROWS = 1 << 16
#: Times that a large group is dealt anew by a quarter of its free bits.
LEVELS = 3
_HASH_BLOCK = 1 << 16
_QUERY_BLOCK = 256


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False)), len(words) - shingle + 1
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    while part := [digest(g, SEED) for g in islice(grams, _HASH_BLOCK)]:
        hashes = np.array(part, "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    over = np.packbits((2 * set_bits > n).astype(np.uint8), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(df: DataFrame) -> DataFrame:
    """Rows (doc_id, th, fp): th hashes the text, fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in blocks(batches, "text"):
            found = np.array([fingerprint(t) for t in texts_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "th", "fp"])

    source = df.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over the codes of several groups; a search stays in the query's group."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), groups))
        self.order, self.codes, groups = order, codes[order], groups[order]
        none, full = np.uint64(0), ~np.uint64(0)
        # levels[0] are the codes themselves; each level keeps its children's span and its last code
        levels = [{"and": self.codes, "or": self.codes, "group": groups, "last": np.arange(len(codes))}]
        while True:
            low = levels[-1]
            start = np.flatnonzero(np.r_[True, low["group"][1:] != low["group"][:-1]])
            size = np.diff(np.r_[start, len(low["group"])])
            if len(levels) > 1 and (size == 1).all():
                break
            within = np.arange(len(low["group"])) - np.repeat(start, size)
            first = np.flatnonzero(within % fanout == 0)
            end = np.r_[first[1:], len(low["group"])]
            levels.append(
                {
                    "and": np.bitwise_and.reduceat(low["and"], first),
                    "or": np.bitwise_or.reduceat(low["or"], first),
                    "group": low["group"][first],
                    "last": low["last"][end - 1],
                    "first": first,
                    "end": end,
                }
            )
        for depth, level in enumerate(levels):
            level["common"] = full ^ (level["and"] ^ level["or"])
            level["n"] = len(level["and"])
        for depth, level in enumerate(levels):
            if depth + 1 < len(levels):
                up = levels[depth + 1]
                parent = np.repeat(np.arange(up["n"]), up["end"] - up["first"])
                level["own"] = level["common"] & ~up["common"][parent]
            else:
                level["own"] = level["common"]
            level["pattern"] = level["and"] & level["own"]
        self.levels, self.none = levels, none
        roots = levels[-1]
        self.root_of = np.repeat(np.arange(roots["n"]), np.diff(np.r_[-1, roots["last"]]))

    def pairs(self, distance: int = DISTANCE, block: int = _QUERY_BLOCK):
        """Batches of index pairs (a < b, in index order) at `distance` or fewer differing bits."""
        n = len(self.codes)
        for begin in range(0, n, block):
            query = np.arange(begin, min(n, begin + block))
            node = self.root_of[query]
            top = self.levels[-1]
            spent = np.bitwise_count((self.codes[query] ^ top["pattern"][node]) & top["own"][node]).astype(np.int8)
            for depth in range(len(self.levels) - 1, 0, -1):
                level, low = self.levels[depth], self.levels[depth - 1]
                size = level["end"][node] - level["first"][node]
                query, spent = np.repeat(query, size), np.repeat(spent, size)
                offset = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
                node = np.repeat(level["first"][node], size) + offset
                ahead = low["last"][node] > query  # each pair once: only codes behind the query's own
                query, spent, node = query[ahead], spent[ahead], node[ahead]
                spent = spent + np.bitwise_count((self.codes[query] ^ low["pattern"][node]) & low["own"][node]).astype(np.int8)
                near = spent <= distance
                query, spent, node = query[near], spent[near], node[near]
            if len(query):
                yield query, node


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connects a[i] with b[i]; labels point at a smallest member and are flat before and after."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while not np.array_equal(flat := labels[labels], labels):
            labels = flat


def link_forest(codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, smaller code) that connect what any chain of links in the groups connects."""
    index = GrayIndex(codes, groups)
    distinct, place = np.unique(codes.view(np.int64), return_inverse=True)
    place = place[index.order]
    labels = np.arange(len(distinct))
    for a, b in index.pairs():
        labels = merge_labels(labels, place[a], place[b])
    moved = np.flatnonzero(labels != np.arange(len(distinct)))
    return distinct[moved], distinct[labels[moved]]


def block_masks(levels: int = LEVELS, bits: int = 64) -> list[list[int]]:
    """Per level, the fixed bits of each path; a path's four children each fix a quarter of its free bits."""
    out, paths = [], [0]
    for _ in range(levels + 1):
        following = []
        for fixed in paths:
            free = [i for i in range(bits) if not fixed >> i & 1]
            cuts = [len(free) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
            following += [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        out.append(following)
        paths = following
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (fp, path) to four rows each: the longer path and the fingerprint's bits it fixes."""
    table = F.array(*(F.lit(_signed(m)) for m in masks))
    out = rows.withColumn("path", F.explode(F.array(*(F.col("path") * (DISTANCE + 1) + k for k in range(DISTANCE + 1)))))
    return out.withColumn("value", F.col("fp").bitwiseAND(F.element_at(table, (F.col("path") + 1).cast("int"))))


def links(spark: SparkSession, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b), b < a, between distinct fingerprints; their components are those of all links."""
    masks = block_masks()
    rows = _deal(nodes.select("fp", F.lit(0).alias("path")), masks[0])
    parts, key = [], ["path", "value"]
    for level in range(LEVELS + 1):
        counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
        counted = scratch.put(rows.join(counts, key), f"level{level}")
        depth = F.lit(level).alias("level")
        parts.append(counted.where(F.col("n") <= GROUP_ROWS).select(depth, "path", "value", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp"))
        large = counted.where(F.col("n") > GROUP_ROWS)
        if large.isEmpty():
            break
        if level < LEVELS:
            rows = _deal(large.select("fp", "path"), masks[level + 1])
        else:  # every pair of slices, so that no link is lost and no task holds the group
            slices = F.ceil(F.col("n") * 2 / GROUP_ROWS).cast("int")
            cut = large.withColumn("s", slices).withColumn("me", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            parts.append(cut.select(depth, "path", "value", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "fp"))
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)

    def run(batches):
        for groups, codes in group_runs(batches):
            a, b = link_forest(codes.view(np.uint64), groups)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # two groups that share a 64-bit name would only be searched together, which adds true links
    named = dealt.select(F.xxhash64("level", "path", "value", "i", "j").alias("g"), "fp")
    return scratch.put(named.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long"), "links")


def group_runs(batches: Iterable[pa.RecordBatch], rows: int = RUN_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns (group, code) of sorted rows, cut into runs of whole groups with `rows` rows or a little
    more; a group has about GROUP_ROWS at most."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size < rows:
            continue
        groups, codes = (np.concatenate(c) for c in zip(*held, strict=True))
        end = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
        if end:
            yield groups[:end], codes[:end]
        held, size = [(groups[end:], codes[end:])], len(groups) - end
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Large star: larger neighbours of a node move to its smallest. Small star: smaller ones and itself do.

    The least neighbours are a written table, so that both sides of the join are dealt anew and a
    node with very many neighbours can be split.
    """
    both = edges.union(edges.select("b", "a")) if large else edges
    least = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) with b < a to rows (a, b): each node that is not the smallest of its component, and that."""
    mark = None
    while True:
        after = scratch.put(_star(_star(edges, True, scratch), False, scratch), "stars")
        scratch.drop(edges)
        edges = after
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edges
        mark = seen


def near_duplicates(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (doc_id, th, fp, first): first is the least (id is null, id, th) of the row's component."""
    scratch = scratch or Scratch(spark, "simhash")
    prints = scratch.put(fingerprints(docs), "prints")
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    nodes = scratch.put(prints.groupBy("fp").agg(F.min(least).alias("least")), "nodes")
    stars = components(links(spark, nodes, scratch), scratch)
    rooted = nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("up")), "fp", "left").select("fp", "least", F.coalesce("up", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = rooted.join(names, "root").select("fp", "first")
    return prints.join(named, "fp")


def simhash_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id."""
    found = near_duplicates(spark, docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline form: of each component one document stays, that with the smallest id (then text hash,
    then the hash of the whole row)."""
    scratch = Scratch(spark, "simhash")
    found = near_duplicates(spark, docs.select("doc_id", "text"), scratch)
    mine = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.th") == F.col("th"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keep = found.where(mine).groupBy(name.alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("th").alias("k3")).agg(F.count("*").alias("k4"))
    keep = scratch.put(keep, "keep")
    packed = docs.select(
        F.struct(*docs.columns).alias("row"),
        name.alias("k1"),
        F.col("doc_id").isNull().alias("k2"),
        F.xxhash64("text").alias("k3"),
    )
    kept = packed.join(keep, ["k1", "k2", "k3"])
    if keep.where("k4 > 1").isEmpty():
        return kept.select("row.*")
    once = kept.where("k4 = 1").select("row")
    repeated = kept.where("k4 > 1").groupBy("k1", "k2", "k3").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row")
    return once.union(repeated).select("row.*")
