"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split where the pre-tokeniser starts a new piece in any case, so the parts'
lengths add up to the whole text's; the parts are packed into batches of about equal bytes.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids are
answered like any other row; an empty table gives an empty result; only the id and text columns
are read, so extra columns never clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, texts_of

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
BATCH_BYTES = 256 << 10
#: Parts of a long text are at least this long, so that cutting costs little.
PART_CHARS = 32 << 10

#: A single space between two other non-space characters: a byte-level piece never spans the gap
#: before it, and no special token holds a space, so cutting in front of it changes no token.
_SAFE = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, Callable[[list[str]], list[int]]] = {}


def vocabulary_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; loaded once a worker."""
    if vocabulary not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(vocabulary)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[vocabulary] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _encoders[vocabulary] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _encoders[vocabulary]


def parts(text: str, least: int = PART_CHARS) -> Iterator[str]:
    """Pieces of `text` that together give its tokens; one piece if it is short or has no safe gap."""
    start = 0
    while len(text) - start > 2 * least:
        gap = _SAFE.search(text, start + least)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:] if start else text


def count(texts: list[str], encode: Callable[[list[str]], list[int]], split: bool = True) -> list[int]:
    totals = [0] * len(texts)
    waiting: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for owner, n in zip(owners, encode(waiting), strict=True):
            totals[owner] += n
        waiting.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in parts(text) if split else (text,):
            if not part:
                continue
            size = len(part.encode())
            if waiting and held + size > BATCH_BYTES:
                flush()
                held = 0
            waiting.append(part)
            owners.append(i)
            held += size
    if waiting:
        flush()
    return totals


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens and over_limit."""
    split = vocabulary.startswith("byte_bpe") and vocabulary.endswith(".json")

    def run(batches):
        encode = encoder(vocabulary)
        for batch in blocks(batches, text_col):
            texts = texts_of(batch, text_col)
            tokens = count(texts, encode, split)
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                }
            )

    source = df.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
