"""Byte-level BPE encoding and decoding by reduction of a monoid tree.

A text is encoded by encoding its halves and joining them, down to short leaves;
so is the byte string of one match of the pattern.  Both joins encode a window
around the border anew and let it grow until what lies outside provably stays:

* Matches of the pattern.  A match that ends two characters before the end of
  the left half has seen nothing beyond it, so it stays.  Matching goes on from
  there until a match ends where one of the right half does, again with two
  characters to spare; as matching looks only ahead, the rest of the right half
  stays.
* Tokens of one match.  A sequence of tokens is the encoding of its bytes when
  every two neighbours are the encoding of theirs.  The window grows until both
  of its borders are such pairs.

Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import read_table, small_batches

LEAF_CHARS = 4096
LEAF_BYTES = 24
#: Encoded matches, and pairs of tokens, that a worker remembers, each.
REMEMBERED = 1 << 18


class Memo(dict):
    """Results of a function by argument.

    Memory is bounded: when it is full it becomes the older generation, which the
    next one replaces.  What is asked for again moves to the younger one, so the
    common arguments stay.
    """

    def __init__(self, function: Callable, most: int = REMEMBERED):
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes and decodes with the ranks of one file (token in base64, rank) and one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.match_ids = Memo(self._match_ids)
        self.stays = Memo(self._stays)
        # One for each token at most.
        self.halves = Memo(self._halves)
        self.right_edge = Memo(lambda rank: self._edge(rank, True))
        self.left_edge = Memo(lambda rank: self._edge(rank, False))

    # One match of the pattern.

    def _match_ids(self, match: str) -> bytes:
        ids = self.reduce_bytes(match.encode())
        return pack(f"<{len(ids)}I", *ids)

    def reduce_bytes(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(piece) <= LEAF_BYTES:
            return self._leaf(piece)
        half = len(piece) // 2
        return self._join_tokens(self.reduce_bytes(piece[:half]), self.reduce_bytes(piece[half:]))

    def _leaf(self, piece: bytes) -> tuple[int, ...]:
        """By definition: merge the neighbours of lowest rank, the leftmost first, until none is a token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = self.ranks.get, len(self.ranks)
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at] = merged = parts[at] + parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + merged, none)
            if at < len(pairs):
                pairs[at] = get(merged + parts[at + 1], none)
        return tuple([self.ranks[p] for p in parts])

    def _halves(self, rank: int) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        token = self.bytes[rank]
        if len(token) == 1:
            return None
        return next((token[:k], token[k:]) for k in range(1, len(token)) if self._made_of(token, k, rank))

    def _made_of(self, token: bytes, k: int, rank: int) -> bool:
        a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
        return a is not None and b is not None and a < rank and b < rank and self._stays((a, b), rank)

    def _edge(self, rank: int, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at one end of this token while it is made, each with the rank that ends it."""
        out, until = [], 1 << 60
        while True:
            out.append((self.bytes[rank], until))
            halves = self.halves[rank]
            if halves is None:
                return out
            until, rank = rank, self.ranks[halves[right]]

    def _stays(self, pair: tuple[int, int], below: int = 1 << 60) -> bool:
        """No merge of a rank under ``below`` crosses the border of the two.

        Ranks only rise while a token is made, since a merge ranks after both its
        parts.  So a crossing merge comes first if it ranks before the ones that
        end the tokens at the border; of equal ranks the left one comes first.
        """
        ranks = self.ranks
        for x, x_until in self.right_edge[pair[0]]:
            for y, y_until in self.left_edge[pair[1]]:
                rank = ranks.get(x + y)
                if rank is not None and rank < below and rank < x_until and rank <= y_until:
                    return False
        return True

    def _join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if self.stays[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._leaf(self.decode(left[len(left) - i :] + right[:j]))
            before = i == len(left) or self.stays[left[len(left) - i - 1], window[0]]
            after = j == len(right) or self.stays[window[-1], right[j]]
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if before else 2 * i), (j if after else 2 * j)

    # A whole text.

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null."""
        return self.packed(text).tolist()

    def packed(self, text: str | None) -> np.ndarray:
        """The same ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.match_ids.__getitem__, self._matches(text or ""))), "<u4")

    def _matches(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self._join_matches(self._matches(text[:half]), text[half:], self._matches(text[half:]))

    def _join_matches(self, left: list[str], right_text: str, right: list[str]) -> list[str]:
        tail = ""
        while left and len(tail) < 2:
            tail = left.pop() + tail
        reach = 64
        while True:
            window = tail + right_text[:reach]
            whole = reach >= len(right_text)
            found, k, border = [], 0, len(tail)  # border: where match k of the right half begins in the window
            for m in self.pattern.finditer(window):
                if not whole and m.end() + 2 > len(window):
                    break
                found.append(m.group())
                while border < m.end() and k < len(right):
                    border += len(right[k])
                    k += 1
                if border == m.end() and border >= len(tail):
                    return left + found + right[k:]
            if whole:
                return left + found
            reach *= 2

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process; the file of ranks lies on every node."""
    return Encoder(path, pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of each whole text as array<int>; an empty array for null and empty texts.  A narrow step."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        return pd.Series([own.packed(t).astype(np.int32) for t in texts], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of each array of ids; empty for null."""
    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        return pd.Series([own.decode(r.tolist()) if r is not None else b"" for r in rows], dtype=object)

    return decode(ids)


def digests(text: Column, path: str, pattern: str) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256 of each whole text, for checks of a round trip.

    Texts are encoded and their ids decoded again in one call, so the ids, which
    take more room than the texts, never leave the worker.  Null counts as empty.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, rows = encoder(path, pattern), []
        for t in texts:
            ids = own.packed(t)
            rows.append((len(ids), sha256(ids).hexdigest(), sha256(own.decode(ids.tolist())).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


@query("op5_tree_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as a count and digests of the ids and of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(F.col("text"), path, pattern).alias("d")).select("doc_id", "d.*")
