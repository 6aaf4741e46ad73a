"""Text functions: words, labels, literal terms, identities, digests and chunks.

Everything is a Column expression inside code generation, but for what Spark has no built-in for:
English stems and normalised identities are Arrow functions over arrays or whole columns.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from .stem import stem

#: Words that are neither indexed nor counted.
STOP_WORDS = tuple("a an the of in on at to for by with and or is are was were be been being that this these those as from it its".split())
MAX_WORD_CHARS = 64
MAX_LABEL_BYTES = 64
CHUNK_CHARS, CHUNK_BYTES = 9_500, 14_000
_SPACE = r"\p{IsWhite_Space}"


def trim_space(text: Column) -> Column:
    """Without leading and trailing Unicode white space (trim() knows blanks only)."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def words(text: Column) -> Column:
    """Lower-cased alphanumeric words without stop words and overlong ones, in order."""
    parts = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda w: (w != "") & (F.char_length(w) <= MAX_WORD_CHARS) & ~w.isin(*STOP_WORDS))


def plain_words(text: str) -> list[str]:
    """words() on the driver, for queries."""
    out, now = [], []
    for c in text.lower() + " ":
        if c.isalnum():
            now.append(c)
        elif now:
            w = "".join(now)
            if len(w) <= MAX_WORD_CHARS and w not in STOP_WORDS:
                out.append(w)
            now = []
    return out


def has_control(text: Column) -> Column:
    return text.rlike(r"\p{Cc}")


def label(raw: Column) -> Column:
    """Normalised topic or tag; null where it is empty, overlong or has control characters."""
    low = F.lower(trim_space(raw))
    return F.when((low != "") & (F.octet_length(low) <= MAX_LABEL_BYTES) & ~has_control(low), low)


def labels(raw: Column, most: int = 8) -> Column:
    """Normalised tags, sorted and distinct; null if there are over `most` or one is invalid."""
    clean = F.transform(raw, label)
    return F.when((F.size(raw) <= most) & ~F.exists(clean, lambda x: x.isNull()), F.array_sort(F.array_distinct(clean)))


def literal_terms(query: str, most: int = 8, max_bytes: int = 256) -> list[str]:
    """Case-folded literal terms of a recall query."""
    if len(query.encode()) > max_bytes:
        raise ValueError(f"query is over {max_bytes} bytes")
    terms = query.lower().split()
    if len(terms) > most:
        raise ValueError(f"query has over {most} terms")
    return terms


def keyword_query(text: Column, most: int = 8, chars: int = 256) -> Column:
    """Words of a question for an engine that takes keywords only: the first ones, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.slice(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)), 1, most)
    return F.substring(F.array_join(kept, " "), 1, chars)


def contains_all(text: Column, terms: list[str]) -> Column:
    """Every term is a substring of the lower-cased text."""
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(F.lower(text), F.lit(term))
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def stem_counts(column: pd.Series) -> pd.Series:
    """Counts of English stems of each row's words; stems of words seen are kept for the batch."""
    seen: dict[str, str] = {}
    out = []
    for row in column:
        counts: dict[str, int] = {}
        for w in row if row is not None else ():
            s = seen.get(w)
            if s is None:
                s = seen[w] = stem(w)
            counts[s] = counts.get(s, 0) + 1
        out.append([{"term": t, "tf": n} for t, n in counts.items()])
    return pd.Series(out)


@pandas_udf(T.StringType())
def stem_en(column: pd.Series) -> pd.Series:
    """English stems; meant for a vocabulary, not for every token."""
    return column.map(lambda w: None if w is None else stem(w))


def plain_identity(text: str) -> str:
    """Composed, case-folded form under which two spellings are one identity."""
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()).split())


@pandas_udf(T.StringType())
def identity(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else plain_identity(x))


def digest(value: object) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no blanks, non-ASCII kept."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def plain_chunks(text: str, chars: int = CHUNK_CHARS, size: int = CHUNK_BYTES) -> Iterator[str]:
    """Lossless parts of at most `chars` characters and `size` UTF-8 bytes, each as long as can be."""
    at = 0
    while at < len(text):
        part = text[at : at + chars].encode()
        if len(part) > size:
            part = part[:size]
        piece = part.decode("utf-8", "ignore")
        yield piece
        at += len(piece)


@udtf(returnType=T.StructType([T.StructField("part", T.IntegerType()), T.StructField("content", T.StringType())]))
class ChunkText:
    """Table function over a text: its parts, numbered from 0."""

    def eval(self, text: str):
        for i, part in enumerate(plain_chunks(text or "")):
            yield i, part


def fixed_chunks(text: Column, chars: int = CHUNK_CHARS) -> Column:
    """Array of (part, content) at a constant stride; the same as ChunkText while no part is over the byte limit."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(chars))
    return F.transform(starts, lambda s, i: F.struct(i.alias("part"), F.substring(text, s + 1, F.lit(chars)).alias("content")))
