"""Quality rules with compression bands.

The base rules count words, symbols, repeated lines and words in repeated five-word windows. The
bands compress each whole document, its fixed chunks and its last 2 KiB, with zstandard: a ratio above the limit
for the document's length says repetitive, one below it says incompressible.

Defined results: a null text has no words (all counts 0, base_failed, not kept); texts under 64
bytes have no band; repeated rows, ties and null ids are answered row by row; an empty table gives
an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import WORD_SPACE, blocks, texts_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Words from which runs are compared as numbers, in some 50 bytes a word.
LONG_WORDS = 200_000
REPEAT_PERCENT = 20
LEVEL = 3
CHUNK_BYTES = 2048
#: Share of whole chunks outside the chunk band from which a document is rejected.
CHUNK_SHARE = 0.5
CHUNK_BAND = (1.4, 2.22)
#: Least and most ratio of raw to compressed bytes, by bit length of the raw size.
#: Prose compresses the better the longer it is, so each length class has limits of its own; the
#: upper ones lie about 0.1 above the highest ratio of prose, the lower ones below random base64.
#: From 2 MiB up, where the compressor's window is full, ratios hardly rise.
BANDS = {
    7: (0.70, 1.60),
    8: (0.85, 1.75),
    9: (1.05, 1.90),
    10: (1.20, 2.12),
    11: (1.35, 2.27),
    12: (1.40, 2.34),
    13: (1.45, 2.45),
    14: (1.45, 2.52),
    15: (1.45, 2.60),
    16: (1.45, 2.66),
    17: (1.45, 2.75),
    18: (1.45, 2.75),
    19: (1.45, 2.76),
    20: (1.45, 2.78),
    21: (1.45, 2.79),
    22: (1.45, 2.80),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in a `window`-word run that occurs twice or more, its first occurrence included."""
    if len(words) <= window:
        return 0
    if len(words) > LONG_WORDS:
        return _repeated_in_long(words, window)
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    covered = bytearray(len(words))
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            covered[i : i + window] = b"\1" * window
    return sum(covered)


def _repeated_in_long(words: list[bytes], window: int) -> int:
    """The same over numbers: runs are ranked by the ranks of two shorter runs, which overlap at last."""
    numbers: dict[bytes, int] = {}
    run = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    length = 1
    while length < window:
        more = min(length, window - length)
        pairs = run[:-more] * (run.max() + 1) + run[more:]
        run, length = np.unique(pairs, return_inverse=True)[1], length + more
    at = np.flatnonzero(np.bincount(run)[run] > 1)
    cover = np.zeros(len(words), np.bool_)
    for k in range(window):
        cover[at + k] = True
    return int(cover.sum())


def band_fails(raw: bytes, compressor: zstandard.ZstdCompressor) -> bool:
    """Whether the whole document or too many of its fixed chunks leave their band, its last chunk
    (which overlaps the one before it, where the length is no multiple) counted or not."""
    if len(raw) < 64:
        return False
    least, most = BANDS[min(len(raw).bit_length(), max(BANDS))]
    if not least <= len(raw) / len(compressor.compress(raw)) <= most:
        return True
    if len(raw) < CHUNK_BYTES:
        return False
    view = memoryview(raw)

    def leaves(at: int) -> bool:
        ratio = CHUNK_BYTES / len(compressor.compress(view[at : at + CHUNK_BYTES]))
        return not CHUNK_BAND[0] <= ratio <= CHUNK_BAND[1]

    chunks = len(raw) // CHUNK_BYTES
    outside = sum(leaves(at * CHUNK_BYTES) for at in range(chunks))
    if outside >= CHUNK_SHARE * chunks:
        return True
    return len(raw) % CHUNK_BYTES > 0 and outside + leaves(len(raw) - CHUNK_BYTES) >= CHUNK_SHARE * (chunks + 1)


def profile(text: str, compressor: zstandard.ZstdCompressor) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, WORD_SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    kept = not failed and not band_fails(raw, compressor)
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats, failed, kept


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the base counts, base_failed and kept."""

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in blocks(batches, text_col):
            rows = [profile(t, compressor) for t in texts_of(batch, text_col)]
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *FIELDS])

    source = df.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{f} long" for f in FIELDS[:5])
    return source.mapInArrow(run, f"`{id_col}` {kind}, {longs}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pipeline form: the rows that the rules keep, with all their columns."""

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in blocks(batches, text_col):
            keep = [profile(t, compressor)[-1] for t in texts_of(batch, text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
