"""SimHash, decontamination, mixture, repeats: against brute force and on odd rows."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from memloom.llm import decontam, mixture, repeats, simhash

COLUMNS = "doc_id long, text string, source string, size long, taken string, row string, k1 int, fp int, n_hit int, bucket int"


def frame(spark, rows):
    """(id, text[, source]) with columns whose names clash with results and inner names."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 1, "t", "r", 2, 3, 4, 5) for r in rows], COLUMNS)


def order(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# ---------------------------------------------------------------- SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def check_components(spark, rows):
    got = [tuple(r) for r in simhash.simhash_components(spark, frame(spark, rows)).collect()]
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = defaultdict(list)
    for (i, _), c in zip(rows, label, strict=True):
        least[c] += [i] if i is not None else []
    want = [(i, f"{p:016x}", min(least[c], default=None)) for (i, _), p, c in zip(rows, prints, label, strict=True)]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words)))
    check_components(spark, rows + [(100, None), (101, ""), (102, " \n"), (103, "One"), (104, "one two"), (5, rows[5][1]), (None, rows[7][1]), (None, "solo words here now")])
    check_components(spark, [])


@pytest.mark.parametrize("n,limit", [(1, 4), (200, 4), (400, 16)])
def test_large_groups_lose_no_link(spark, monkeypatch, n, limit):
    """Dense clouds of fingerprints pass through all levels and the slices."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    monkeypatch.setattr(simhash, "LEVELS", 1)
    rng = random.Random(n)
    centre = [rng.getrandbits(64) for _ in range(2)]
    codes = sorted({rng.choice(centre) ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(4))) for _ in range(n)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    nodes = spark.createDataFrame([(c,) for c in signed], "fp long")
    scratch = simhash.Scratch(spark, "test")
    stars = {r["a"]: r["b"] for r in simhash.components(simhash.links(spark, nodes, scratch), scratch).collect()}
    label = brute_components(codes)
    groups, got = defaultdict(set), defaultdict(set)
    for c, s, k in zip(codes, signed, label, strict=True):
        groups[k].add(s)
        got[stars.get(s, s)].add(s)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 5).astype(np.uint64)
    codes = np.unique(np.array([int(rng.choice(centres)) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for _ in range(700)], np.uint64))
    groups = rng.integers(0, 2, len(codes))
    index = simhash.GrayIndex(codes, groups)
    got = {frozenset((int(index.order[a]), int(index.order[b]))) for x, y in index.pairs(block=97) for a, b in zip(x, y, strict=True)}
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 3) & (groups[:, None] == groups[None])
    assert got == {frozenset((a, b)) for a, b in zip(*np.nonzero(near), strict=True) if a != b}


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_runs_of_whole_groups(rows):
    rng = np.random.default_rng(rows)
    groups = np.sort(rng.integers(-5, 20, 300))
    codes = rng.integers(0, 99, 300)
    cuts = np.sort(rng.integers(0, 300, 9))
    batches = [pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "fp"]) for g, c in zip(np.split(groups, cuts), np.split(codes, cuts), strict=True)]
    runs = list(simhash.group_runs(batches, rows))
    assert np.concatenate([g for g, _ in runs]).tolist() == groups.tolist() and np.concatenate([c for _, c in runs]).tolist() == codes.tolist()
    assert all(a[-1] != b[0] for (a, _), (b, _) in zip(runs, runs[1:], strict=False))
    assert list(simhash.group_runs([])) == []


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "one two three", 2), ("a", "one two three", 1), (None, "one two three", 3), ("a", "one two three", 0)], "doc_id string, text string, n int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(spark, df).collect()), key=order)
    assert got == [("a", "a"), ("a", "a"), ("b", "a"), (None, "a")]
    assert len({tuple(simhash.keep_first(spark, df.orderBy(o)).collect()[0]) for o in ("n", F.desc("n"))}) == 1


def test_one_document_of_each_group_stays(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(4, text), (2, text), (2, text), (3, "something else entirely in this row"), (None, text), (None, "alone"), (None, "alone")]
    df = frame(spark, rows)
    got = simhash.keep_first(spark, df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == sorted([(2, text), (3, rows[3][1]), (None, "alone")], key=order)
    assert simhash.keep_first(spark, frame(spark, [])).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, window=13):
    words = decontam.words_of(text)
    hit, found = bytearray(len(words)), set()
    for name, other in items:
        w = decontam.words_of(other)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[a : a + k]:
                    hit[i : i + k] = b"\1" * k
                    found.add("" if name is None else str(name))
    return len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(words)


def decontam_case(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.contamination(spark, frame(spark, docs), bench).collect()]
    want = [(i, *brute_hits(t, items)) for i, t in docs]
    assert sorted(got, key=order) == sorted(want, key=order)


def random_case(seed):
    rng = random.Random(seed)
    letters = "a B c é 7".split()
    items = [(k, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 13, 14, 30])))) for k in range(9, 15)] + [(None, "q r s"), (9, "zz top"), (20, None)]
    docs = []
    for i in range(25):
        words = [rng.choice(letters + ["other"]) for _ in range(rng.choice([0, 3, 60]))]
        if rng.random() < 0.6:
            words[1:1] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "-", "\n", "; "]).join(words)))
    return docs + [docs[3], (None, docs[4][1]), (50, None), (51, "A, a... A!")], items


@pytest.mark.parametrize("seed", range(3))
def test_contamination(spark, seed):
    decontam_case(spark, *random_case(seed))


def test_contamination_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    docs, items = random_case(9)
    decontam_case(spark, docs, items + items[:2] * 20)  # equal rows count once


def test_words_of_one_hash(spark):
    """Thue-Morse words and their complements have one polynomial hash to a modulus of 2**64."""
    bits = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)]
    assert len(set(decontam.Hasher()(np.frombuffer(" ".join(bits).encode(), np.uint8), np.array([0, 2049]), np.array([2048, 4097])).tolist())) == 1
    docs = [(1, f"x {bits[0]} y"), (2, f"x {bits[1]} y"), (3, " ".join(bits)), (4, "a b")]
    for items in ([(1, bits[0]), (2, bits[1])], [(1, bits[0])], [(1, f"y {bits[1]}"), (2, "a b")]):
        decontam_case(spark, docs, items)


@pytest.mark.parametrize("limit", [1, 7, 100, 5000])
def test_long_documents_are_searched_in_pieces(limit):
    rng = random.Random(limit)
    docs, items = random_case(limit)
    text = " ".join((t or "") for _, t in docs * 3) + " é " + "z" * 50
    items = [("" if i is None else str(i), t) for i, t in items]
    marker = decontam.Marker(decontam.Phrases(items))
    whole, cut = marker.shard([text], len(text) * 4), marker.shard([text], limit)
    assert whole == cut and whole[1][0] and whole[0] == [len(decontam.words_of(text))]
    raw = text.encode().lower()
    parts = list(decontam.pieces(raw, limit, 13))
    assert sum(n for _, n in parts) == whole[0][0] and (limit > 100 or len(parts) > 3)


def test_contamination_of_empty_tables(spark):
    decontam_case(spark, [], [(1, "a b")])
    decontam_case(spark, [(1, "a b"), (2, None)], [])


def test_driver_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    own = {}
    for name, text in items:
        w = decontam.words_of(text)
        for a in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            own.setdefault(tuple(w[a : a + min(13, len(w))]), set()).add(name)
    sizes = {len(k) for k in own}
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.contamination(spark, docs, bench).collect()}
    for r in docs.collect():
        w = decontam.words_of(r["text"])
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if g := own.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= g
        assert got[r["doc_id"]] == (len(hit), len(found))


def test_decontaminate_drops_and_cuts(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    clean = "nothing of it " * 5
    long = " ".join(f"x{i}" for i in range(400)) + f" Before, {passage.upper()}! After. " + " ".join(f"y{i}" for i in range(400))
    docs = spark.createDataFrame([(1, clean, 3), (2, f"{passage} and more", 4), (3, long, 5), (4, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(spark, docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[1]["text"] == clean and got[1]["n_chars"] == 3 and got[4]["text"] is None
    assert got[3]["text"] == long.replace(passage.upper(), "") and got[3]["n_chars"] == len(got[3]["text"])


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (50, 2), (300, 3), (200, 60_000)):
        s = rng.integers(1, top + 1, n)
        s = np.concatenate([s, s[: n // 2]])
        got = decontam.suffix_array(s, top).tolist()
        assert got == sorted(range(len(s)), key=lambda i: s[i:].tolist())


# ---------------------------------------------------------------- mixture


def test_targets():
    assert mixture.targets({"a": 600, "b": 600, "c": 600}) == {"a": 300, "b": 600, "c": 900}
    got = mixture.targets({"b": 10, "a": 1000, None: 10})
    assert got["b"] == 30 and got[None] == 30 and got["a"] == 960
    assert mixture.targets({}) == {} and mixture.targets({"a": 0}) == {"a": 0}


def test_flow_fills_quotas_at_least_cost():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 50}
    sent = mixture.route(patterns, {"a": 150.0, "b": 250.0})
    assert sum(sent.values()) == 400 and all(sent[k] <= 3 * patterns[k] for k in patterns)
    assert all(v >= patterns[k] for k, v in sent.items())  # the free pass comes first


def test_flow_against_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        patterns = {("a",): rng.randint(0, 3), ("a", "b"): rng.randint(0, 3), ("b",): rng.randint(0, 3)}
        quotas = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}
        sent = mixture.route(patterns, quotas)
        cost = lambda k, v: sum(min(max(v - i * patterns[k], 0), patterns[k]) * c for i, c in enumerate(mixture.PASS_COSTS))
        best = None
        top = {k: 3 * v for k, v in patterns.items()}
        for x in range(top["a",] + 1):
            for y in range(top["b",] + 1):
                for za in range(top["a", "b"] + 1):
                    for zb in range(top["a", "b"] + 1 - za):
                        if x + za <= quotas["a"] and y + zb <= quotas["b"]:
                            key = (-(x + y + za + zb), cost(("a",), x) + cost(("b",), y) + cost(("a", "b"), za + zb))
                            best = key if best is None else min(best, key)
        assert (-sum(sent.values()), sum(cost(k, v) for k, v in sent.items())) == best


def test_flow_over_many_sources():
    rng = random.Random(3)
    patterns = {(f"s{i}",): rng.randint(1, 1000) for i in range(10_000)}
    sizes = {k[0]: v for k, v in patterns.items()}
    began = time.perf_counter()
    quotas = mixture.targets(sizes)
    sent = mixture.route(patterns, quotas)
    assert all(sent[k] == min(round(quotas[k[0]]), 3 * v) for k, v in patterns.items())
    both = {(f"s{rng.randrange(2000)}", f"s{2000 + rng.randrange(2000)}"): rng.randint(1, 1000) for _ in range(10_000)}
    room = {s: 700.0 for k in both for s in k}
    assert 0 < sum(mixture.route(both, room).values()) <= 700 * len(room)
    assert time.perf_counter() - began < 10


def test_equal_rows_are_taken_in_part(spark):
    """A source of 200 equal rows of 10 words, one of two rows, and one large document."""
    rows = [(1, " ".join(["w"] * 10), "a")] * 200 + [(2, "x y z", "b")] * 2 + [(3, " ".join(["v"] * 3000), "c")]
    got = mixture.mix(spark, frame(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["doc_id"]] += r["taken"]
        target[r["doc_id"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert len(got) == len(rows) and target[1] == pytest.approx((5006 - 18) / 4) and abs(taken[1] - target[1]) <= 10 and taken[2] == 18


def test_documents_of_several_sources(spark):
    """Equal texts count for each source that has them; the flow fills both quotas."""
    rows = [(i, f"{'w ' * 9}{i}", "a") for i in range(60)] + [(100 + i, f"{'w ' * 9}{i}", "b") for i in range(20)] + [(200 + i, f"{'w ' * 9}{i + 500}", "b") for i in range(10)]
    df = frame(spark, rows)
    both = df.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("of"))
    got = mixture.mix(spark, both, members=F.col("of")).collect()
    words = sum(r["taken"] for r in got)
    assert len(got) == 70 and words == sum(r["size"] * (r["taken"] // r["size"]) for r in got)
    want = mixture.targets({"a": 600, "b": 300})
    assert abs(words - sum(min(want[s], 3 * {"a": 600, "b": 300}[s]) for s in want)) <= 20


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice(["a", "b", "c", None])) for i in range(800)] + [(900, None, "a"), (None, "x y", "b"), (5, "x", "z"), (6, "\n", "empty")]
    df = frame(spark, rows)
    out = mixture.mix(spark, df)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=order) == sorted(map(tuple, mixture.mix(spark, df.repartition(7)).collect()), key=order)
    size, source = defaultdict(int), {}
    for i, t, s in rows:
        size[s] += len((t or "").split())
        source[i] = s
    want = mixture.targets(dict(size))
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        if r["doc_id"] not in (5, 6):
            assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in ("a", "b", "c", None):
        assert abs(taken[s] - want[s]) <= 30
    assert mixture.mix(spark, frame(spark, [])).count() == 0


def test_mixed_documents(spark):
    rows = [(i, "one two three", "a" if i % 2 else "b") for i in range(50)]
    got = mixture.mixed_documents(spark, frame(spark, rows))
    assert got.columns == [c for c in frame(spark, rows).columns if c not in ("size", "taken")] + ["size", "source_size", "target", "taken"]
    assert all(r["taken"] > 0 for r in got.collect())


# ---------------------------------------------------------------- repeats


def brute_repeats(rows, window=50):
    key = lambda i: (i is None, i or 0)
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in raw:
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < key(i):
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, rows, limits=None):
    got = [tuple(r) for r in repeats.repeated_text(spark, frame(spark, rows), limits=limits).collect()]
    assert sorted(got, key=order) == sorted(brute_repeats(rows), key=order)


SHAPES = {
    "plain": repeats.Limits(),
    "short segments": repeats.Limits(segment=100, sorted_at_once=20),
    "short runs": repeats.Limits(segment=60, at_once=200, sampled=1),
    "outgrown buckets": repeats.Limits(segment=300, held=400, sorted_at_once=1),
    "hot anchors": repeats.Limits(sampled=1, hot_units=0, hot_anchors=40, sorted_at_once=100),
    "all hot and outgrown": repeats.Limits(sampled=1, hot_units=0, hot_anchors=10_000, held=300),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_repeats(spark, shape):
    rng = random.Random(shape)
    for letters in ("ab", "abcdefgh é", "a"):
        make = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        pool = [make(rng.choice([30, 49, 50, 51, 90, 300])) for _ in range(6)]
        rows = [(rng.choice([i, i, i, None, 3, 2**63 - 1]), "".join(rng.choice(pool) if rng.random() < 0.6 else make(rng.choice([0, 5, 60])) for _ in range(rng.randint(0, 5)))) for i in range(60)]
        check_repeats(spark, rows + rows[:3] + [(7, None), (8, "")], SHAPES[shape])
    check_repeats(spark, [], SHAPES[shape])


def test_repeats_of_one_phrase(spark):
    """A phrase of a third of the rows in ever other words; many rows without an id."""
    rng = random.Random(5)
    phrase = "all rights are reserved by the owner of this text."
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i if i % 4 else None, f"{words(9)} {phrase} {words(9)}" if i % 3 == 0 else words(20)) for i in range(400)]
    for limits in (repeats.Limits(), repeats.Limits(sampled=1, hot_units=20), repeats.Limits(held=2000)):
        check_repeats(spark, rows + rows[:40], limits)


def test_repeats_over_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_repeats(spark, rows)


def test_radix_passes():
    """Windows that differ only in their last byte, or in the first, are told apart."""
    base = bytes(range(33, 83))
    texts = [base, base, base[:49] + b"z", b"z" + base[1:], base[:25] + b"z" + base[26:], base]
    got = repeats.repeated_windows(b"".join(texts), np.arange(6) * 50, np.zeros(6, np.int64), np.array([3, 1, 0, 0, 0, 1]))
    assert got.tolist() == [True, False, False, False, False, False]
    apart = repeats.repeated_windows(b"".join(texts), np.arange(6) * 50, np.array([0, 1, 0, 0, 0, 1]), np.array([3, 1, 0, 0, 0, 2]))
    assert apart.tolist() == [False] * 5 + [True]
    assert repeats.digits_of(b"abcdefghi").tolist() == [int.from_bytes(b"abcdefgh", "big"), int.from_bytes(b"bcdefghi", "big")]
    assert not len(repeats.digits_of(b"abc"))


def test_union_of_runs():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        for k in (0, 1, 8):
            first = rng.integers(0, n, k)
            last = np.minimum(n - 1, first + rng.integers(0, 9, k))
            want = np.zeros(n, np.bool_)
            for a, b in zip(first, last, strict=True):
                want[a : b + 1] = True
            assert repeats.union_of([(first[:3], last[:3]), (first[3:], last[3:])], n).tolist() == want.tolist()
    assert repeats.union_of([], 4).tolist() == [False] * 4


def test_packing():
    a, b = np.arange(5, dtype=np.uint64) << np.uint64(40), np.arange(5, dtype=np.int32) - 2
    x, y, tail = repeats.unpack(repeats.pack(a, b, tail=b"xyz"), "u8", "i4")
    assert (x == a).all() and (y == b).all() and tail == b"xyz"
