"""Removal of byte strings that an earlier document has: a depth-limited radix sort of suffixes.

Suffixes are ordered through the threshold of 50 bytes only, by most-significant-digit passes: a
pass sorts each group of suffixes that are still equal by their next eight bytes, cuts it where these
differ, and drops the parts that one document alone has. What is together after the last digit is
exactly one repeated window; bytes are compared, never hashes of them.

Suffixes meet by content. Each window is dealt by its anchor, the 20 bytes with the least hash among
those it covers, so equal windows meet; neighbouring windows mostly share their anchor, and such a run
(a unit) travels as one record with its bytes. The hash only deals records to buckets, a collision
merely puts more suffixes into one sort. A bucket's units that are equal as a whole are decided at
once, and only anchors with several different units enter the passes.

* Every shard of documents first decides what it can itself: of equal units it sends one record.
* Shards first send their anchors only, in 40 bits, and learn which of them others have too; units
  travel only where an anchor is shared. (Two anchors that agree in these bits merely travel.)
* Anchors that very many different units hold (a phrase of a third of all documents) are found from a
  sample of the shards and come last in the choice of anchors; windows that have no other are dealt
  one by one by all their bytes. The sample changes where suffixes meet, never the result.
* A bucket whose different units outgrow `Limits.held` bytes all the same is dealt anew by windows in a second round.
* Buckets and shards are streamed in order from sorted partitions, whose number follows the input's
  bytes: a task holds one bucket or one shard at a time.

Defined results: a null text is empty; texts under 50 bytes lose nothing; rows that repeat an id are
judged each on its own and never against one another (each row has a name of its own); a null id
counts as larger than all ids; ids are integers; an empty table gives an empty result; only the id and
text columns are read by name. A task holds a single text, however long, about five times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks

THRESHOLD = 50
ANCHOR = 20
#: First byte of each digit of eight bytes; the last one overlaps, so that all end at the threshold.
DIGITS = (*range(0, THRESHOLD - 8, 8), THRESHOLD - 8)
#: Bytes of text in a shard (a single longer text is a shard of its own) and in a partition.
SHARD_BYTES = 2 << 20
PARTITION_BYTES = 16 << 20
MAX_PARTITIONS = 1 << 16
_P1, _P2 = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)
#: Names of a task's shards: its number times this, and on.
_TASK = 1 << 32
#: Low bits of an anchor that are not sent.
_SENT = np.uint64(23)
_LOW24, _TOP = np.uint64((1 << 24) - 1), np.uint64(1 << 63)


@dataclass(frozen=True)
class Limits:
    """Sizes that change the work's shape, never its result."""

    #: Bytes that are hashed at once; longer texts are cut into segments that overlap by a window.
    segment: int = 256 << 10
    #: Bytes whose units are held at once.
    at_once: int = 4 << 20
    #: Bytes of text that a bucket stands for, and bytes of different units that it may hold.
    bucket: int = 8 << 20
    held: int = 32 << 20
    #: Windows that are sorted at once.
    sorted_at_once: int = 1 << 20
    #: One shard in this many is looked through for common anchors; those of more units than
    #: `hot_units` by its estimate are hot, the `hot_anchors` most common ones at most.
    sampled: int = 16
    hot_units: int = 100_000
    hot_anchors: int = 4096


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _P2
    return x ^ (x >> np.uint64(32))


def digits_of(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number; greater numbers are greater bytes."""
    n = len(data)
    out = np.empty(max(0, n - 7), np.uint64)
    for o in range(min(8, len(out))):
        out[o::8] = np.frombuffer(data, ">u8", (n - o) // 8, o)
    return out


def starts_of(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first .. first + count - 1 of each row, and the row of each."""
    owner = np.repeat(np.arange(len(first)), count)
    return np.arange(len(owner)) - np.repeat(starts_of(count) - first, count), owner


def heads_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    new = np.ones(len(sorted_keys[0]), np.bool_)
    if len(new):
        new[1:] = False
        for key in sorted_keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


# ---------------------------------------------------------------- the radix sort


def repeated_windows(data: bytes, starts: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows of `data` have their equal of smaller rank in their group.

    Windows of different groups are known to differ. Most-significant-digit passes through the
    threshold; groups of one rank are dropped as soon as they are.
    """
    digits = digits_of(data)
    out = np.zeros(len(starts), np.bool_)
    alive, last = np.arange(len(starts)), DIGITS[-1]
    for depth in DIGITS:
        if not len(alive):
            break
        digit = digits[starts[alive] + depth]
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        heads = heads_of(group, digit)
        size, ranks = np.diff(np.r_[heads, len(alive)]), rank[alive]
        least = np.minimum.reduceat(ranks, heads)
        if depth == last:
            out[alive[ranks > np.repeat(least, size)]] = True
            break
        kept = np.repeat(least != np.maximum.reduceat(ranks, heads), size)
        group, alive = np.repeat(np.arange(len(heads)), size)[kept], alive[kept]
    return out


# ---------------------------------------------------------------- units


def segments(sizes: list[int], limit: int, window: int = THRESHOLD) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, start, end) whose bytes come to about `limit`; no window is lost or doubled."""
    held, size = [], 0
    for i, n in enumerate(sizes):
        start = 0
        while n - start >= window:
            end = min(n, start + limit + window - 1)
            if held and size + end - start > limit + window:
                yield held
                held, size = [], 0
            held.append((i, start, end))
            size += end - start
            start = end - window + 1
    if held:
        yield held


def runs_of(sizes: list[int], limits: Limits) -> Iterator[list[list[tuple[int, int, int]]]]:
    """Segments, a shard's worth at a time: all of a shard, or a part of a very long text."""
    held: list[list[tuple[int, int, int]]] = []
    size = 0
    for parts in segments(sizes, limits.segment):
        own = sum(b - a for _, a, b in parts)
        if held and size + own > limits.at_once:
            yield held
            held, size = [], 0
        held.append(parts)
        size += own
    if held:
        yield held


class Hot:
    """The hot anchors; a table of their leading bits answers for most others."""

    def __init__(self, anchors: Iterable[int] = ()):
        self.anchors = np.array(sorted(anchors), np.uint64)
        self.table = np.zeros(1 << 16, np.bool_)
        self.table[(self.anchors >> np.uint64(47)).astype(np.int64)] = True

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        """Places of hot ones."""
        if not len(self.anchors):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(anchors >> np.uint64(47)).astype(np.int64)])
        return maybe[np.isin(anchors[maybe], self.anchors)]


def window_name(digits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """63-bit hash of the windows at these places; deals them to buckets."""
    out = np.zeros(len(at), np.uint64)
    for depth in DIGITS:
        out = mix((out ^ digits[at + depth]) * _P1)
    return out >> np.uint64(1)


@dataclass
class Units:
    """Runs of windows, each of a text's row: anchor, its place from the first window on, windows
    behind the first, row, first window, and the bytes."""

    anchor: np.ndarray
    place: np.ndarray
    span: np.ndarray
    row: np.ndarray
    offset: np.ndarray
    body: list[bytes]

    def take(self, at: np.ndarray) -> Units:
        return Units(self.anchor[at], self.place[at], self.span[at], self.row[at], self.offset[at], [self.body[i] for i in at.tolist()])

    def windows(self) -> Units:
        """Each window on its own, dealt by all its bytes."""
        count = self.span.astype(np.int64) + 1
        inner, owner = spread(np.zeros(len(count), np.int64), count)
        data = b"".join(self.body)
        at = np.repeat(starts_of(count + THRESHOLD - 1), count) + inner
        none = np.zeros(len(at), np.uint8)
        body = [data[i : i + THRESHOLD] for i in at.tolist()]
        return Units(window_name(digits_of(data), at), none, none, self.row[owner], self.offset[owner] + inner, body)

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        arrays = (np.concatenate([getattr(p, name) for p in parts]) for name in ("anchor", "place", "span", "row", "offset"))
        return Units(*arrays, [b for p in parts for b in p.body])


def units_of(parts: list[tuple[int, int, int]], raw: list[bytes], hot: Hot, bytes_too: bool = True) -> list[Units]:
    """The units of some texts' parts; of windows with hot anchors only, one a window."""
    data = b"".join(raw[i][a:b] for i, a, b in parts)
    n = len(data)
    digits = digits_of(data)
    m = n - ANCHOR + 1
    hashes = mix((digits[:m] * _P1) ^ mix(digits[8 : 8 + m] * _P2 + digits[12 : 12 + m])) >> np.uint64(1)
    hashes[hot(hashes)] |= _TOP  # only a window without others takes them
    # least anchor of each window: packed (hash, place), minimum over doubling spans
    least, width, covers = (hashes & ~_LOW24) | np.arange(m, dtype=np.uint64), 1, THRESHOLD - ANCHOR + 1
    while 2 * width <= covers:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (covers - width)], least[covers - width :])
    place = (least & _LOW24).astype(np.int64)
    size = np.array([b - a for _, a, b in parts])
    begin = starts_of(size)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size - THRESHOLD + 1, -1)
    valid = np.cumsum(inside, dtype=np.int8)[: len(place)] > 0
    change = np.r_[True, place[1:] != place[:-1]]
    first = np.flatnonzero(valid & (change | ~np.r_[False, valid[:-1]]))
    last = np.flatnonzero(valid & (np.r_[change[1:], True] | ~np.r_[valid[1:], False]))
    part = np.searchsorted(begin, first, side="right") - 1
    row = np.array([i for i, _, _ in parts])[part]
    offset = first - begin[part] + np.array([a for _, a, _ in parts])[part]
    at = place[first]
    common = hashes[at] >= _TOP

    def units(chosen: np.ndarray, bodies: bool) -> Units:
        x, y = first[chosen], last[chosen]
        body = [data[a:b] for a, b in zip(x.tolist(), (y + THRESHOLD).tolist(), strict=True)] if bodies else []
        return Units(hashes[at[chosen]], (at[chosen] - x).astype(np.uint8), (y - x).astype(np.uint8), row[chosen], offset[chosen], body)

    found = [units(np.flatnonzero(~common), bytes_too)]
    return [*found, units(np.flatnonzero(common), True).windows()] if common.any() else found


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of one length and a byte string; wide integers are split by byte, so that equal bytes
    lie together."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.compress(b"".join([*out, tail]), 1)


def unpack(blob: bytes, *kinds: str) -> list:
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        t = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * t.itemsize
    return [*out, raw[at:]]


def by_key(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its places, which keep their order."""
    order = np.argsort(key, kind="stable")
    heads = heads_of(key[order])
    for a, b in zip(heads.tolist(), np.r_[heads[1:], len(order)].tolist(), strict=False):
        yield int(key[order[a]]), order[a:b]


#: What travels: `part` deals it, `key` names its bucket or its shard, kinds of a shard in this order.
_ROWS = "part int, key long, kind int, payload binary"
_MARKS, _LINKS, _SHARED, _TEXTS, _UNITS, _ANCHORS = range(6)
_UNIT = ("u8", "u1", "u1", "u4", "u4", "i8", "u1")  # anchor, place, span, row, offset, id, id is null
_MARK = ("u4", "u4", "u4")  # row, first and last window
_LINK = ("u4", "u4", "u1", "u4", "u4")  # row, offset, span; row and offset of its equal
_TEXT = ("i8", "u1", "u8")  # id, id is null, bytes
Row = tuple[int, int, int, bytes]


def rows(found: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[3]) + 32
        if size > 2 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[Row]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "key", "kind", "payload"])


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


# ---------------------------------------------------------------- shards


def packed_shards(batches: Iterable[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows (shard, n_bytes, payload, common) of documents in order of their id; `common` has a sampled
    shard's anchors that several of its units share, with their number."""
    task = TaskContext.get()
    name = (task.partitionId() if task else 0) * _TASK
    names = ["shard", "n_bytes", "payload", "common"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    ids: list = []
    raw: list[bytes] = []
    size = 0

    def put() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        texts = [raw[i] for i in order]
        head = (np.array([ids[i] or 0 for i in order], np.int64), np.array([ids[i] is None for i in order], np.uint8), np.array(list(map(len, texts)), np.uint64))
        common = None
        if name % limits.sampled == 0:
            seen = [different_anchors([u for p in parts for u in units_of(p, texts, Hot())]) for parts in runs_of(list(map(len, texts)), limits)]
            anchors, count = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
            common = pack(anchors[count > 1], count[count > 1].astype(np.int64))
        values = (name, size, pack(*head, tail=b"".join(texts)), common)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    for batch in blocks(batches, "text", 1 << 20):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            if raw and size + len(t) > SHARD_BYTES:
                yield put()
                name, ids, raw, size = name + 1, [], [], 0
            ids.append(i)
            raw.append(t)
            size += len(t)
    if raw:
        yield put()


def different_anchors(parts: list[Units]) -> np.ndarray:
    """The anchor of each different unit."""
    units = Units.joined(parts)
    return units.anchor[list({b: i for i, b in enumerate(units.body)}.values())]


def read_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, which are null, and texts."""
    ids, null, size, data = unpack(payload, *_TEXT)
    cuts = np.cumsum(np.r_[0, size.astype(np.int64)]).tolist()
    return ids, null, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Deal:
    """Partitions, and buckets dealt to them."""

    parts: int
    buckets: int

    def bucket(self, anchor: np.ndarray) -> np.ndarray:
        return (mix(anchor) % np.uint64(self.buckets)).astype(np.int64)

    def home(self, shard):
        """Partition of a shard, given as a number or as a column."""
        return (shard // _TASK * 1_000_003 + shard % _TASK) % self.parts if isinstance(shard, int) else self._home(shard)

    def _home(self, shard: Column) -> Column:
        task = F.shiftright(shard, 32)
        return F.pmod(task * 1_000_003 + (shard - task * _TASK), F.lit(self.parts)).cast("int")


def packed_units(deal: Deal, shard: int, units: Units, ids: np.ndarray, null: np.ndarray) -> Iterator[Row]:
    name = shard.to_bytes(8, "little")
    for bucket, at in by_key(deal.bucket(units.anchor)):
        u = units.take(at)
        columns = (u.anchor, u.place, u.span, u.row, u.offset, ids[at], null[at])
        yield bucket % deal.parts, bucket, _UNITS, pack(*(c.astype(k) for c, k in zip(columns, _UNIT, strict=True)), tail=name + b"".join(u.body))


def shard_anchors(shard: int, payload: bytes, deal: Deal, hot: Hot, limits: Limits) -> Iterator[Row]:
    """A shard's anchors by bucket, in rising order."""
    _, _, raw = read_shard(payload)
    for run, parts in enumerate(runs_of(list(map(len, raw)), limits)):
        anchors = np.unique(np.concatenate([u.anchor for p in parts for u in units_of(p, raw, hot, bytes_too=False)]))
        for bucket, at in by_key(deal.bucket(anchors)):
            yield bucket % deal.parts, bucket, _ANCHORS, pack(anchors[at] >> _SENT, tail=shard.to_bytes(8, "little") + run.to_bytes(4, "little"))


def reduce_anchors(found: Iterable[Row], deal: Deal) -> Iterator[Row]:
    """To each shard of a bucket, which of its anchors there another shard (or another run of a long
    one) has too, as bits behind the numbers of the bucket and the run."""
    shards: list[bytes] = []
    sent: list[np.ndarray] = []

    def reply(bucket: int) -> Iterator[Row]:
        every = np.concatenate(sent)
        order = np.argsort(every)
        again = np.r_[False, every[order][1:] == every[order][:-1]]
        again[:-1] |= again[1:]
        shared = np.empty(len(every), np.bool_)
        shared[order] = again
        ends = np.cumsum([len(a) for a in sent])
        for name, bits in zip(shards, np.split(shared, ends[:-1]), strict=True):
            shard = int.from_bytes(name[:8], "little")
            yield deal.home(shard), shard, _SHARED, bucket.to_bytes(8, "little") + name[8:] + np.packbits(bits).tobytes()

    now = -1
    for _, key, _, payload in found:
        if key != now and sent:
            yield from reply(now)
            shards.clear()
            sent.clear()
        now = key
        anchors, tail = unpack(payload, "u8")
        shards.append(tail)
        sent.append(anchors)
    if sent:
        yield from reply(now)


def shard_units(shard: int, payload: bytes, replies: list[bytes], deal: Deal, hot: Hot, limits: Limits) -> Iterator[Row]:
    """A shard's different units of shared anchors by bucket, and what it can tell of the others itself."""
    ids, null, raw = read_shard(payload)
    told: dict[int, dict[int, bytes]] = {}
    for r in replies:
        told.setdefault(int.from_bytes(r[8:12], "little"), {})[int.from_bytes(r[:8], "little")] = r[12:]
    for run, parts in enumerate(runs_of(list(map(len, raw)), limits)):
        found = [u for p in parts for u in units_of(p, raw, hot)]
        yield from run_units(shard, found, ids, null, told[run], deal)


def run_units(shard: int, parts: list[Units], ids: np.ndarray, null: np.ndarray, told: dict[int, bytes], deal: Deal) -> Iterator[Row]:
    units = Units.joined(parts)
    order = np.lexsort((units.offset, units.row))  # documents lie in order of their id
    units = units.take(order)
    first: dict[bytes, int] = {}
    known = np.array([first.setdefault(b, i) for i, b in enumerate(units.body)], np.int64)
    first.clear()
    row, me = units.row, np.arange(len(known))
    same = (ids[row] == ids[row[known]]) & (null[row] == null[row[known]])
    gone = np.flatnonzero(~same)
    if len(gone):  # a smaller document of the shard has them; runs side by side become one
        r, s, e = row[gone], units.offset[gone], units.offset[gone] + units.span[gone]
        new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != e[:-1] + 1)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(r)] - 1
        yield deal.home(shard), shard, _MARKS, pack(*(c.astype("u4") for c in (r[head], s[head], e[tail])))
    link = np.flatnonzero(same & (known != me))
    if len(link):
        to = known[link]
        columns = (row[link], units.offset[link], units.span[link], row[to], units.offset[to])
        yield deal.home(shard), shard, _LINKS, pack(*(c.astype(k) for c, k in zip(columns, _LINK, strict=True)))
    anchors, at = np.unique(units.anchor, return_inverse=True)
    shared = np.zeros(len(anchors), np.bool_)
    for bucket, places in by_key(deal.bucket(anchors)):
        shared[places] = np.unpackbits(np.frombuffer(told[bucket], np.uint8))[: len(places)]
    # anchors that several documents of this shard have
    owner = ranks(ids, null)[row]
    least, most = np.full(len(anchors), len(ids)), np.zeros(len(anchors), np.int64)
    np.minimum.at(least, at, owner)
    np.maximum.at(most, at, owner)
    units = units.take(np.flatnonzero((known == me) & (shared | (least < most))[at]))
    yield from packed_units(deal, shard, units, ids[units.row], null[units.row])


def cut_shards(found: Iterable[Row], deal: Deal, hot: Hot, limits: Limits) -> Iterator[Row]:
    """Shards in order, the replies first."""
    replies: list[bytes] = []
    for _, shard, kind, payload in found:
        if kind == _SHARED:
            replies.append(payload)
        else:
            yield from shard_units(shard, payload, replies, deal, hot, limits)
            replies.clear()


# ---------------------------------------------------------------- buckets


class Bucket:
    """Units of one bucket from many shards; finds windows that a smaller document has too.

    While records come in, those that equal another of a smaller document are told and left out.
    If different units outgrow the limit, the bucket hands all on as single windows.
    """

    def __init__(self, deal: Deal, limits: Limits, again: bool):
        self.deal, self.limits, self.again = deal, limits, again
        self.parts: list[tuple[Units, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.full = 0, False

    def add(self, payload: bytes) -> Iterator[Row]:
        *columns, tail = unpack(payload, *_UNIT)
        anchor, place, span, row, offset, ids, null = columns
        ends = np.cumsum(span.astype(np.int64) + THRESHOLD).tolist()
        body = [tail[8 + a : 8 + b] for a, b in zip([0, *ends], ends, strict=False)]
        units = Units(anchor, place, span, row, offset.astype(np.int64), body)
        shard = np.full(len(anchor), int.from_bytes(tail[:8], "little"), np.int64)
        self.parts.append((units, shard, ids, null))
        self.size += len(tail)
        if self.full:
            yield from self.hand_on()
        elif self.size > self.limits.held:
            yield from self.compact()
            if 2 * self.size > self.limits.held and not self.again:
                self.full = True
                yield from self.hand_on()

    def _held(self) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
        units, shard, ids, null = zip(*self.parts, strict=True)
        return Units.joined(list(units)), np.concatenate(shard), np.concatenate(ids), np.concatenate(null)

    def hand_on(self) -> Iterator[Row]:
        """All that is held as single windows, shard by shard."""
        if not self.parts:
            return
        units, shard, ids, null = self._held()
        self.parts, self.size = [], 0
        for name, at in by_key(shard):
            some = units.take(at)
            count = some.span.astype(np.int64) + 1
            # the bucket is dealt anew from the anchor once the size of the second round is known
            yield from packed_units(Deal(1, 1), name, some.windows(), np.repeat(ids[at], count), np.repeat(null[at], count))

    def compact(self) -> Iterator[Row]:
        """Tells whole units that a smaller document has too; the others stay."""
        if not self.parts:
            return
        units, shard, ids, null = self._held()
        rank = ranks(ids, null)
        first: dict[bytes, int] = {}
        known = np.array([first.setdefault(b, i) for i, b in enumerate(units.body)], np.int64)
        first.clear()
        least = rank.copy()
        np.minimum.at(least, known, rank)
        gone = rank > least[known]
        at = np.flatnonzero(gone)
        yield from self.marks(shard[at], units.row[at], units.offset[at], units.offset[at] + units.span[at])
        at = np.flatnonzero(~gone)
        units = units.take(at)
        self.parts, self.size = [(units, shard[at], ids[at], null[at])], sum(map(len, units.body))

    def marks(self, shard: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[Row]:
        for name, at in by_key(shard):
            yield self.deal.home(name), name, _MARKS, pack(*(c[at].astype("u4") for c in (row, first, last)))

    def close(self) -> Iterator[Row]:
        if self.full:
            yield from self.hand_on()
            return
        yield from self.compact()
        if not self.parts:
            return
        units, shard, ids, null = self._held()
        self.parts = []
        rank = ranks(ids, null)
        # of equal units (of one id now) one is looked at, for all of them
        first: dict[bytes, int] = {}
        known = np.array([first.setdefault(b, i) for i, b in enumerate(units.body)], np.int64)
        order = np.array(sorted(first.values()), np.int64)
        first.clear()
        order = order[np.argsort(units.anchor[order], kind="stable")]
        heads = heads_of(units.anchor[order])
        size = np.diff(np.r_[heads, len(order)])
        group = np.repeat(np.arange(len(heads)), size)
        if not len(heads):
            return
        ranked = rank[order]
        open_ = np.minimum.reduceat(ranked, heads) != np.maximum.reduceat(ranked, heads)
        chosen = open_[group]
        order, group = order[chosen], group[chosen]
        if not len(order):
            return
        found = [self.sort(units, rank, order[a:b], group[a:b]) for a, b in self.chunks(units, group, order)]
        unit, inner = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((inner, unit))
        unit, inner = unit[by], inner[by]
        new = np.r_[True, (unit[1:] != unit[:-1]) | (inner[1:] != inner[:-1] + 1)] if len(unit) else np.zeros(0, np.bool_)
        head = np.flatnonzero(new)
        unit, a, b = unit[head], inner[head], inner[np.r_[head[1:], len(inner)][: len(head)] - 1]
        # runs of a unit hold for all its equals
        by = np.argsort(known, kind="stable")
        low, high = np.searchsorted(known[by], unit, side="left"), np.searchsorted(known[by], unit, side="right")
        at, run = spread(low, high - low)
        of = by[at]
        yield from self.marks(shard[of], units.row[of], units.offset[of] + a[run], units.offset[of] + b[run])

    def chunks(self, units: Units, group: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of whole anchors with about as many windows as may be sorted at once."""
        heads = heads_of(group).tolist()
        sums = np.cumsum(units.span[order].astype(np.int64) + 1)
        start = 0
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            if a > start and sums[b - 1] - (sums[start - 1] if start else 0) > self.limits.sorted_at_once:
                yield start, a
                start = a
        if start < len(order):
            yield start, len(order)

    def sort(self, units: Units, rank: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, window) of the windows of some anchors' units that a smaller document has too."""
        count = units.span[order].astype(np.int64) + 1
        place = units.place[order].astype(np.int64)
        data = b"".join([units.body[i] for i in order.tolist()])
        begin = starts_of(count + THRESHOLD - 1)
        covers = THRESHOLD - ANCHOR + 1
        found = []
        # an anchor of very many units is sorted by its place in the window, one after the other
        steps = [(0, covers)] if count.sum() <= 2 * self.limits.sorted_at_once else [(p, p + 1) for p in range(covers)]
        for low, high in steps:
            # windows (counted from the unit's first) in which the anchor's place is in low .. high - 1
            first = np.maximum(0, place - high + 1)
            stop = np.minimum(count, place - low + 1)
            if len(steps) == 1:
                first, stop = np.zeros(len(count), np.int64), count
            inner, owner = spread(first, np.maximum(0, stop - first))
            key = group[owner] * covers + place[owner] - inner
            at = np.flatnonzero(repeated_windows(data, begin[owner] + inner, key, rank[order][owner]))
            found.append((order[owner[at]], inner[at]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ranks(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Dense rank by id, null last."""
    order = np.lexsort((ids, null))
    out = np.empty(len(ids), np.int64)
    heads = heads_of(ids[order], null[order])
    out[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(ids)]))
    return out


def reduce_units(found: Iterable[Row], deal: Deal, limits: Limits, again: bool = False) -> Iterator[Row]:
    """Buckets in order; rows of other kinds pass."""
    bucket, now = None, None
    for part, key, kind, payload in found:
        if kind != _UNITS:
            yield part, key, kind, payload
            continue
        if key != now:
            if bucket:
                yield from bucket.close()
            bucket, now = Bucket(deal, limits, again), key
        yield from bucket.add(payload)
    if bucket:
        yield from bucket.close()


def deal_anew(found: Iterable[Row], deal: Deal) -> Iterator[Row]:
    """Windows of outgrown buckets, by the buckets of the second round."""
    for *_, payload in found:
        *columns, tail = unpack(payload, *_UNIT)
        anchor, place, span, row, offset, ids, null = columns
        body = [tail[8 + a : 8 + a + THRESHOLD] for a in range(0, len(tail) - 8, THRESHOLD)]
        yield from packed_units(deal, int.from_bytes(tail[:8], "little"), Units(anchor, place, span, row, offset, body), ids, null)


# ---------------------------------------------------------------- results

_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_spans(marks: np.ndarray, window: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the marked windows cover."""
    at = np.flatnonzero(marks)
    if not len(at):
        return at, at
    head = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + window])
    return at[head], at[np.r_[head[1:], len(at)] - 1] + window


def kept_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]) if out else raw


def finish(found: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    """Shards in order: marks and links first, then the texts that they are of."""
    marks: list[list[np.ndarray]] = []
    links: list[list[np.ndarray]] = []
    for _, _, kind, payload in found:
        if kind == _MARKS:
            marks.append(unpack(payload, *_MARK)[:3])
        elif kind == _LINKS:
            links.append(unpack(payload, *_LINK)[:5])
        else:
            yield _results(payload, marks, links)
            marks, links = [], []


def union_of(runs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Which of n places some run first .. last covers."""
    step = np.zeros(n + 1, np.int8)
    if sum(len(a) for a, _ in runs):
        first, last = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(first)
        first, reach = first[order], np.maximum.accumulate(last[order])
        head = np.flatnonzero(np.r_[True, first[1:] > reach[:-1] + 1])  # runs that touch are one
        step[first[head]] = 1
        step[reach[np.r_[head[1:], len(first)] - 1] + 1] = -1
    return np.cumsum(step[:-1], dtype=np.int8).view(np.bool_)


def _results(payload: bytes, marks: list[list[np.ndarray]], links: list[list[np.ndarray]]) -> pa.RecordBatch:
    ids, null, raw = read_shard(payload)
    base = np.cumsum([0, *(max(0, len(r) - THRESHOLD + 1) for r in raw)])  # of each text's windows
    gone = union_of([(base[row] + first, base[row] + last) for row, first, last in marks], base[-1])
    for row, offset, span, row2, offset2 in links:  # equal units of one id share their verdict
        count = span.astype(np.int64) + 1
        there, _ = spread(base[row] + offset, count)
        here, _ = spread(base[row2] + offset2, count)
        gone[there] |= gone[here]
    removed, n_spans, digest = [], [], []
    for i, text in enumerate(raw):
        starts, ends = removed_spans(gone[base[i] : base[i + 1]])
        removed.append(int((ends - starts).sum()))
        n_spans.append(len(starts))
        digest.append(hashlib.sha256(kept_bytes(text, starts, ends)).hexdigest())
    numbers = [pa.array(list(map(len, raw)), pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())]
    arrays = [pa.array(ids, pa.int64(), mask=null.astype(np.bool_)), *numbers, pa.array(digest, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def hot_anchors(shards: DataFrame, total: int, limits: Limits) -> Hot:
    """Anchors that very many different units hold, by the sampled shards."""
    sampled = shards.where(F.col("common").isNotNull())
    seen = sampled.agg(F.sum("n_bytes")).first()[0] or 0

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                anchor, n, _ = unpack(blob, "u8", "i8")
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    least = limits.hot_units * seen / max(1, total)
    counted = sampled.select("common").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > least).orderBy(F.desc("n"), "anchor").limit(limits.hot_anchors).collect()
    return Hot(r["anchor"] for r in found)


def repeated_text(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, limits: Limits | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    scratch, limits = scratch or Scratch(spark, "repeats"), limits or Limits()
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = scratch.put(source.mapInArrow(lambda b: packed_shards(b, limits), "shard long, n_bytes long, payload binary, common binary"), "shards")
    total = shards.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, min(MAX_PARTITIONS, -(-total // PARTITION_BYTES)))
    deal = Deal(parts, parts * max(1, -(-total // (parts * limits.bucket))))
    hot = hot_anchors(shards, total, limits)

    def anchors(batches):
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows(shard_anchors(shard, payload, deal, hot, limits))

    def met(df: DataFrame, deal: Deal) -> DataFrame:
        return df.repartitionById(deal.parts, F.col("part")).sortWithinPartitions("key", "kind")

    sent = shards.select("shard", "payload").mapInArrow(anchors, _ROWS)
    replies = scratch.put(met(sent, deal).mapInArrow(lambda b: rows(reduce_anchors(_rows_of(b), deal)), _ROWS), "replies")
    texts = shards.select(deal.home(F.col("shard")).alias("part"), F.col("shard").alias("key"), F.lit(_TEXTS).alias("kind"), "payload")
    units = met(replies.unionByName(texts), deal).mapInArrow(lambda b: rows(cut_shards(_rows_of(b), deal, hot, limits)), _ROWS)
    told = scratch.put(met(units, deal).mapInArrow(lambda b: rows(reduce_units(_rows_of(b), deal, limits)), _ROWS), "told")
    outgrown = told.where(F.col("kind") == _UNITS)
    told = told.where(F.col("kind") != _UNITS)
    if not outgrown.isEmpty():
        size = outgrown.agg(F.sum(F.octet_length("payload"))).first()[0]
        # packed windows take a byte or more of theirs
        second = replace(deal, buckets=parts * max(1, -(-size * THRESHOLD // (parts * limits.bucket))))
        anew = outgrown.mapInArrow(lambda b: rows(deal_anew(_rows_of(b), second)), _ROWS)
        more = met(anew, second).mapInArrow(lambda b: rows(reduce_units(_rows_of(b), second, limits, again=True)), _ROWS)
        told = told.unionByName(scratch.put(more, "more"))
    return met(told.unionByName(texts), deal).mapInArrow(lambda b: finish(_rows_of(b)), _RESULT)
