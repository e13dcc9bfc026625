"""Token ids of whole corpora by a byte-level BPE vocabulary, in linear time.

A text is split by the vocabulary's pattern.  Within a piece, the encoder takes
the longest token that an Aho-Corasick automaton finds at its position, and
keeps it if the pair with the token before is compatible: if no merge of lower
rank would have crossed the border between them.  Otherwise it tries the next
shorter token, or steps back.  Positions that led nowhere are remembered, so
no position is tried twice and the time is linear in the piece.  The result is
exactly that of applying the merges one by one.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import once, widen
from waymesh.session import map_arrow

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_PIECES = 200_000
_LONG_PIECE = 40


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id; ids must be dense."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


def merge_splits(tokens: list[bytes]) -> np.ndarray:
    """For each token the two tokens whose merge makes it, found by merging its bytes with lower ranks; bytes split into themselves."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = np.empty((len(tokens), 2), np.int32)
    for i, t in enumerate(tokens):
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError(f"token {i} is not made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out[i] = (rank[parts[0]], rank[parts[-1]]) if len(parts) == 2 else (i, i)
    return out


class Encoder:
    """Encoder and decoder of one vocabulary; ``tokens`` by id and their merge splits."""

    def __init__(self, tokens: list[bytes], splits: np.ndarray, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.length = [len(t) for t in tokens]
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.tokens = tokens
        self.left, self.right = splits[:, 0].tolist(), splits[:, 1].tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if len(tokens[i]) > 1}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = b"".join(tokens)

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        got = self.shorter.get(token)
        if got is None:
            t = self.tokens[token]
            got = next((r for n in range(len(t) - 1, 0, -1) if (r := self.rank.get(t[:n])) is not None), -1)
            self.shorter[token] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b when they stand side by side.

        The merges that made both tokens are undone from the latest on; at each
        point no earlier merge may join what then meets at the border.
        """
        got = self.fits.get((a, b))
        if got is not None:
            return got
        x, y, bound = a, b, len(self.tokens)
        while True:
            joined = self.merged.get((x, y))
            if joined is not None and joined < bound:
                got = False
                break
            if x > y:  # of equal merges the right one came later
                inner = self.right[x]
                if inner != x:
                    x, bound = inner, x
                    continue
                inner = self.left[y]
                if inner == y:
                    got = True
                    break
                y, bound = inner, y + 1
            else:
                inner = self.left[y]
                if inner != y:
                    y, bound = inner, y + 1
                    continue
                inner = self.right[x]
                if inner == x:
                    got = True
                    break
                x, bound = inner, x
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = got
        return got

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of text."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        longest, length, fits, prefix = self.automaton.iter_long, self.length, self.compatible, self.prefix
        n, pos, out = len(text), 0, []
        alive = bytearray(b"\x01") * (n + 1)
        token = next(longest(text, 0))[1]
        while True:
            last = out[-1] if out else -1
            while True:
                end = pos + length[token]
                if alive[end] and (last < 0 or fits(last, token)):
                    out.append(token)
                    pos = end
                    if pos == n:
                        return out
                    token = next(longest(text, pos))[1]
                    break
                token = prefix(token)
                if token < 0:
                    alive[pos] = 0
                    out.pop()
                    pos -= length[last]
                    token = last
                    # the token that led here is tried again only in a shorter form: its end is dead now
                    break

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for p in self.pieces(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= _LONG_PIECE:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        o, b = self.offsets, self.bytes
        return b"".join([b[o[i] : o[i + 1]] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=8)
def vocabulary(path: str) -> tuple[bytes, bytes, bytes]:
    """A rank file in a form that is cheap to send: joined tokens, their lengths, their merge splits (about 1 MB)."""
    tokens = read_ranks(path)
    return b"".join(tokens), np.array([len(t) for t in tokens], np.int32).tobytes(), merge_splits(tokens).tobytes()


_made: dict[int, Encoder] = {}


def encoder(packed: tuple[bytes, bytes, bytes]) -> Encoder:
    """The encoder of a packed vocabulary, made once in each Python worker."""
    key = hash(packed)
    if key not in _made:
        joined, lengths, splits = packed
        ends = [0, *itertools.accumulate(np.frombuffer(lengths, np.int32).tolist())]
        _made[key] = Encoder([joined[a:b] for a, b in zip(ends, ends[1:])], np.frombuffer(splits, np.int32).reshape(-1, 2))
    return _made[key]


def _with_encoder(df: DataFrame, make: Callable, schema: str, path: str) -> DataFrame:
    """mapInArrow with the vocabulary as a broadcast; its size is that of the rank file, whatever the corpus."""
    packed = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(packed.value)
        for b in batches:
            if b.num_rows:
                yield from make(enc, b)

    return map_arrow(df, run, schema)


def token_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids array<int>) of each document; text is taken from ``text``.

    Null and empty texts give an empty list, blank texts are encoded like any
    other, and strings of special tokens are ordinary text.  A document that
    comes several times counts once, as first received.  Other columns are
    ignored.
    """
    docs = once(documents.select("doc_id", "text", "received_at"), "doc_id", "received_at").select("doc_id", "text")

    def make(enc: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, ends = array("i"), [0]
        for t in b.column(1).to_pylist():
            if t:
                flat.extend(enc.encode(t))
            ends.append(len(flat))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return _with_encoder(widen(docs), make, "doc_id bigint, ids array<int>", path)


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) of each document, counted once as ``token_ids`` does."""
    docs = once(documents.select("doc_id", "source", "text", "received_at"), "doc_id", "received_at").select("doc_id", "source", "text")

    def make(enc: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = [len(enc.encode(t)) if t else 0 for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return _with_encoder(widen(docs), make, "doc_id bigint, source string, n_tokens bigint", path)


def texts_of(encoded: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text) decoded from (doc_id, ids); null ids give a null text, bytes that are no UTF-8 the replacement character."""

    def make(enc: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [None if ids is None else enc.decode(ids) for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _with_encoder(encoded.select("doc_id", F.col("ids").cast("array<int>")), make, "doc_id bigint, text string", path)
