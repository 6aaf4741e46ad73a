"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of documents of about SHARD_BYTES; a longer document is cut into pieces that overlap
by a window. Its words become symbols (benchmark words their own, other words one of OTHER_SYMBOLS by
hash, one end mark a document); hit words are compared byte by byte, and where two words share a hash
the shard's symbols are told by the words themselves. The shard's suffixes are sorted, and the Burrows-Wheeler transform goes into a wavelet matrix. All test windows are searched
backward at once by wavelet ranks; rows that are found are walked to a sampled suffix position.
Overlapping occurrences merge into the spans that are to be removed.

The benchmark's different rows reach the executors in blocks of about BLOCK_BYTES of text (a longer
item is in a block of its own size); CHAIN blocks search the shards side by side in one pass, so no
broadcast grows with the benchmark.

Defined results: a null text has no words and is never contaminated; an item without words has no
window; a null item id is named by the empty string, a repeated one counts once; an empty benchmark
marks nothing; repeated document rows and null ids are answered row by row; an empty table gives an
empty result; only the id and text columns are read by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, set_column, texts_of

WINDOW = 13
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
CHAIN = 2
OTHER_SYMBOLS = 4096
SAMPLE = 16
#: A document is contaminated if hit words are at least one in this many.
SHARE = 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)

SPANS, ITEMS, WORDS = "memloom_spans", "memloom_items", "memloom_words"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Hasher:
    """64-bit polynomial hashes of many byte runs of one buffer, by one product and segment sums."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.powers):
            size = len(data)
            self.powers = np.full(size, _BASE, np.uint64)
            self.powers[0] = 1
            self.powers = np.cumprod(self.powers, dtype=np.uint64)
            self.inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
            self.inverse[0] = 1
            self.inverse = np.cumprod(self.inverse, dtype=np.uint64)
        if not len(starts):
            return np.zeros(0, np.uint64)
        terms = self.powers[: len(data)] * (data.astype(np.uint64) + np.uint64(1))
        cuts = np.empty(2 * len(starts), np.int64)
        cuts[0::2], cuts[1::2] = starts, ends
        last = cuts[-1] == len(data)
        sums = np.add.reduceat(terms, cuts[:-1] if last else cuts)[0::2]
        found = sums * self.inverse[starts]
        found ^= found >> np.uint64(32)  # low bits of a product alone are weak
        return found * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lower-cased buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Phrases:
    """Test windows over a vocabulary: what is broadcast for one block of the benchmark."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        texts: list[np.ndarray] = []
        owner: list[int] = []
        for name, text in items:
            if words := words_of(text):
                texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
                owner.append(names.setdefault(name, len(names)))
        self.names, self.words, self.window = list(names), list(vocabulary), window
        data = np.frombuffer(b" ".join(self.words), np.uint8)
        hashes = Hasher()(data, *word_bounds(data)) if len(data) else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by_hash]
        self.exact = len(np.unique(hashes)) < len(hashes)  # hashes do not tell these words apart
        # windows, right-aligned, -1 in front of short ones; equal ones are one
        length = np.array([min(window, len(t)) for t in texts], np.int64)
        width = int(length.max(initial=1))
        rows = [np.zeros((0, width), np.int32)]
        for t, n in zip(texts, length.tolist(), strict=True):
            part = np.full((len(t) - n + 1, width), -1, np.int32)
            part[:, width - n :] = np.lib.stride_tricks.sliding_window_view(t, n)
            rows.append(part)
        count = np.array([len(x) for x in rows[1:]], np.int64)
        self.symbols, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.sizes = (self.symbols >= 0).sum(axis=1)
        pairs = np.unique(np.stack([which.reshape(-1), np.repeat(np.array(owner, np.int64), count)], axis=1), axis=0)
        self.item = pairs[:, 1]
        self.cuts = np.searchsorted(pairs[:, 0], np.arange(len(self.symbols) + 1))

    def items_of(self, phrase: int) -> list[str]:
        return [self.names[i] for i in self.item[self.cuts[phrase] : self.cuts[phrase + 1]].tolist()]


def suffix_array(symbols: np.ndarray, top: int) -> np.ndarray:
    """Order of all suffixes; a suffix that ends is smaller. Prefix doubling over unresolved groups only."""
    n = len(symbols)
    bits = max(1, int(top + 1).bit_length())
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        key[: n - j] |= symbols[j:].astype(np.int64) + 1 if j < n else 0
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    del key
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups of two and more
    depth = packed
    while len(slots):
        at = order[slots]
        group = rank[at]
        follow = at + depth
        behind = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = group * (n + 2) + behind
        sub = np.argsort(key)
        key, at, group = key[sub], at[sub], group[sub]
        order[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.flatnonzero(new)
        rank[at] = np.repeat(slots[head], np.diff(np.r_[head, len(slots)]))
        slots = slots[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, one bit plane a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        now = symbols.astype(np.uint16 if top < 1 << 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.bool_)
            ranks = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ranks[1:])
            self.ones.append(ranks)
            self.zeros.append(len(now) - int(ranks[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where(symbol >> (self.levels - 1 - i) & 1, zeros + up, at - up)
        return at


class FMIndex:
    """Backward search and location over a sequence; symbol 0 ends documents and starts the order."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        ends = symbols == 0
        n_ends = int(ends.sum())
        unique = symbols.astype(np.int64) + (n_ends - 1)
        unique[ends] = np.arange(n_ends)  # end marks differ, so that no suffix order passes a document
        order = suffix_array(unique, top + n_ends)
        before = order - 1
        before[before < 0] = len(symbols) - 1
        self.bwt = symbols[before]
        self.tree = WaveletMatrix(self.bwt, top)
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.first[1:])
        known = np.arange(top + 1)
        self.origin = self.tree.descend(known, np.zeros(top + 1, np.int64))
        # sampled positions: every `sample`-th, and the first of each document
        marked = (order % sample == 0) | (self.bwt == 0)
        self.marks = np.zeros(len(order) + 1, np.int32)
        np.cumsum(marked, out=self.marks[1:])
        self.sampled = order[marked].astype(np.int32)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.descend(symbol, row) - self.origin[symbol]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [low, high) of each right-aligned phrase that occurs, and which phrase."""
        width = phrases.shape[1]
        which = np.arange(len(phrases))
        last = phrases[:, width - 1]
        low, high = self.first[last], self.first[last + 1]
        for back in range(1, width + 1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if back == width or not len(which):
                break
            more = sizes[which] > back
            symbol = phrases[which[more], width - 1 - back]
            low[more], high[more] = self.step(symbol, low[more]), self.step(symbol, high[more])
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(rows):
            there = self.marks[rows + 1] > self.marks[rows]
            out[left[there]] = self.sampled[self.marks[rows[there]]] + steps
            rows, left = rows[~there], left[~there]
            rows = self.step(self.bwt[rows], rows)
            steps += 1
        return out


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the intervals, and the interval of each."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.repeat(low, size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size), owner


class Marker:
    """Finds a block's windows in shards of texts."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.hash = phrases, Hasher()

    def shard(self, texts: list[str], limit: int = SHARD_BYTES) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Of each text: its words, the hit word ranges (start, end, start, end, ...) and the items."""
        raw = [t.encode().lower() for t in texts]
        if len(raw) > 1 or sum(map(len, raw)) <= 2 * limit:
            return self._search(raw, self.phrases.exact)
        words, spans, items = 0, [], set()
        for piece, own in pieces(raw[0], limit, self.phrases.window):
            _, found, names = self._search([piece], self.phrases.exact)
            spans += [words + x for x in found[0]]
            items.update(names[0])
            words += own
        return [words], [merge_spans(spans, [])], [sorted(items)]

    def _symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool) -> np.ndarray:
        """1 .. OTHER_SYMBOLS for other words, by hash, then the vocabulary."""
        p = self.phrases
        hashes = self.hash(data, starts, ends)
        other = 1 + (hashes % np.uint64(OTHER_SYMBOLS)).astype(np.int64)
        if exact:
            own = {w: OTHER_SYMBOLS + 1 + i for i, w in enumerate(p.words)}
            raw = data.tobytes()
            return np.array([own.get(raw[a:b], o) for a, b, o in zip(starts.tolist(), ends.tolist(), other.tolist(), strict=True)], np.int64)
        place = np.minimum(np.searchsorted(p.hashes, hashes), len(p.hashes) - 1)
        return np.where(p.hashes[place] == hashes, OTHER_SYMBOLS + 1 + p.by_hash[place], other)

    def _search(self, raw: list[bytes], exact: bool) -> tuple[list[int], list[list[int]], list[list[str]]]:
        p = self.phrases
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
        starts, ends = word_bounds(data)
        bounds = np.searchsorted(starts, offsets)
        counts = np.diff(bounds)
        spans: list[list[int]] = [[] for _ in raw]
        items: list[set[str]] = [set() for _ in raw]
        if not len(starts) or not len(p.sizes):
            return counts.tolist(), spans, [[] for _ in raw]
        word = self._symbols(data, starts, ends, exact)
        # symbol 0 ends a document
        top = OTHER_SYMBOLS + len(p.words)
        doc = np.repeat(np.arange(len(raw)), counts)
        symbols = np.zeros(len(word) + len(raw), np.int32)
        symbols[np.arange(len(word)) + doc] = word
        del word
        index = FMIndex(symbols, top)
        which, low, high = index.search(p.symbols + OTHER_SYMBOLS + 1, p.sizes)
        rows, owner = expand(low, high)
        at = index.locate(rows)
        phrase = which[owner]
        begin = np.cumsum(np.r_[0, counts + 1])  # of each document among the symbols
        home = np.searchsorted(begin, at, side="right") - 1
        cover = np.zeros(len(symbols) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.sizes[phrase], -1)
        covered = np.cumsum(cover[:-1]) > 0
        if not exact and not self._same_words(data, starts, ends, symbols, np.flatnonzero(covered)):
            return self._search(raw, True)
        step = np.diff(np.r_[0, covered.view(np.int8), 0])
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        for a, b, d in zip(first.tolist(), last.tolist(), (np.searchsorted(begin, first, side="right") - 1).tolist(), strict=True):
            spans[d] += [a - int(begin[d]), b - int(begin[d])]
        for d, q in np.unique(np.stack([home, phrase], axis=1), axis=0).tolist():
            items[d].update(p.items_of(q))
        return counts.tolist(), spans, [sorted(x) for x in items]

    def _same_words(self, data, starts, ends, symbols, places) -> bool:
        """Whether hit words are the vocabulary's, byte by byte; else a hash was met by chance."""
        word = places - np.cumsum(symbols == 0)[places]
        return all(data[starts[w] : ends[w]].tobytes() == self.phrases.words[s - OTHER_SYMBOLS - 1] for s, w in zip(symbols[places].tolist(), word.tolist(), strict=True))


def pieces(raw: bytes, limit: int, window: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a lower-cased text, cut between words, each with the words behind it that a window may
    reach; and how many words are its own."""
    start, n = 0, len(raw)
    while start < n:
        end = min(n, start + limit)
        while end < n and _IS_WORD[raw[end]]:
            end += 1
        reach = end
        for _, m in zip(range(window - 1), WORD.finditer(raw, end), strict=False):
            reach = m.end()
        yield raw[start:reach], sum(1 for _ in WORD.finditer(raw, start, end))
        start = end


def shards(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = SHARD_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches with about `limit` bytes of text."""
    held, size = [], 0
    for batch in blocks(batches, text_col, limit):
        if not batch.num_rows:
            continue
        own = batch.column(batch.schema.get_field_index(text_col)).nbytes
        if held and size + own > limit * 5 // 4:
            yield held
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield held


def merge_spans(a: list[int], b: list[int]) -> list[int]:
    """Union of two flat lists of ranges."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def benchmark_blocks(bench: DataFrame, scratch: Scratch, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's different (item_id, text) in blocks of about `limit` bytes of text."""
    rows = scratch.put(bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct(), "benchmark")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]  # bounded by the limit


def mark_hits(spark: SparkSession, docs: DataFrame, bench: DataFrame, text_col: str = "text", finish=None) -> DataFrame:
    """`docs` with columns SPANS (flat hit word ranges), ITEMS and WORDS added.

    `finish` turns a batch, its spans and its word counts into a batch of the columns of `docs`; it
    runs in the last pass, beside the search.
    """
    from pyspark.sql import types as T

    state = [T.StructField(SPANS, T.ArrayType(T.LongType())), T.StructField(ITEMS, T.ArrayType(T.StringType())), T.StructField(WORDS, T.LongType())]
    schema = T.StructType([*docs.schema.fields, *state])
    columns = len(docs.columns)
    scratch = Scratch(spark, "decontam")
    marked = None
    todo = benchmark_blocks(bench, scratch, BLOCK_BYTES)
    block, k = next(todo), 0
    while block is not None:
        phrases = spark.sparkContext.broadcast(Phrases(block))
        block, k = next(todo, None), k + 1
        last = block is None

        def run(batches, phrases=phrases, more=marked is not None, end=finish if last else None):
            marker = Marker(phrases.value)
            for held in shards(batches, text_col):
                words, spans, items = marker.shard([t for b in held for t in texts_of(b, text_col)])
                at = 0
                for b in held:
                    cut = slice(at, at := at + b.num_rows)
                    s, i = spans[cut], items[cut]
                    if more:
                        s = [merge_spans(x, y) for x, y in zip(s, b.column(columns).to_pylist(), strict=True)]
                        i = [sorted({*x, *y}) for x, y in zip(i, b.column(columns + 1).to_pylist(), strict=True)]
                    own = pa.RecordBatch.from_arrays(b.columns[:columns], names=b.schema.names[:columns])
                    if end:
                        yield end(own, s, words[cut])
                        continue
                    arrays = [pa.array(s, pa.list_(pa.int64())), pa.array(i, pa.list_(pa.string())), pa.array(words[cut], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own.columns, *arrays], names=[*own.schema.names, SPANS, ITEMS, WORDS])

        if marked is not None and k % CHAIN == 1:
            marked = scratch.put(marked, "marked")
        marked = (docs if marked is None else marked).mapInArrow(run, docs.schema if finish and last else schema)
    return marked


def _hit_words():
    ends = F.filter(SPANS, lambda x, i: i % 2 == 1)
    starts = F.filter(SPANS, lambda x, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return total(ends) - total(starts)


def contamination(spark: SparkSession, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    marked = mark_hits(spark, docs.select(id_col, text_col), bench, text_col)
    found = marked.select(
        id_col,
        F.col(WORDS).alias("n_words"),
        _hit_words().alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col(ITEMS), ","), 256).alias("items_sha256"),
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the given word ranges; what stands between words of a range goes with it."""
    raw = text.encode()
    bounds = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(spark: SparkSession, docs: DataFrame, bench: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Pipeline form: contaminated documents go; the spans hit in others are cut out, all else stays."""

    def finish(batch, spans, words):
        hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        keep = [not h or SHARE * h < n for h, n in zip(hits, words, strict=True)]
        spans = [s for s, k in zip(spans, keep, strict=True) if k]
        batch = batch.filter(pa.array(keep, pa.bool_()))
        if any(spans):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            after = [cut_words(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            batch = set_column(batch, text_col, pa.array(after, pa.string()))
            if length_col in batch.schema.names:
                old = batch.column(batch.schema.get_field_index(length_col)).to_pylist()
                batch = set_column(batch, length_col, pa.array([len(t) if s else o for t, s, o in zip(after, spans, old, strict=True)], pa.int64()))
        return batch

    return mark_hits(spark, docs, bench, text_col, finish)
