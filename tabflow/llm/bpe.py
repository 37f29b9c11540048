"""Byte-level byte-pair encoding and decoding, exact and in linear time.

The bytes of a piece of text are mapped one to one to Latin-1 characters, in which
an Aho-Corasick automaton finds all tokens at all places. The encoding is then
found by backtracking from the longest match at each place: a token is accepted if
the pair that it forms with the token before it is what the merges themselves give
for the two together, which is looked up in a memo. Each place is given up at most
once, so the time is linear in the length of the piece.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tabflow.llm.shared import column, map_batches, ship

# White space as the Unicode property has it; Python's own adds four control characters.
_SPACE = r"\t-\r \x85\xa0  -     　"


def split_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` compiled with ``\\s`` and ``\\S`` as the White_Space property."""
    inside = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def tokens_of(path: str) -> list[bytes]:
    """The bytes of each id of a rank file, which is all that decoding takes."""
    ranks = read_ranks(path)
    tokens = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode_ids(tokens: list[bytes], packed: bytes) -> bytes:
    """The bytes that packed ids stand for; an unknown id raises."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Codec(dict):
    """Encoder for one rank file; as a dict, the memo of encoded pieces.

    ``codec[piece]`` is the packed ids of a piece of text.
    """

    #: Pieces kept in the memo, the longest of them, and pairs of tokens kept.
    KEEP, KEEP_LENGTH, KEEP_PAIRS = 200_000, 64, 300_000

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.findall = split_pattern(pattern).findall
        self.tokens = tokens_of(path)
        self.lengths = list(map(len, self.tokens))
        self.pairs: dict[tuple[int, int], bool] = {}
        # The two tokens that merge last into a token; single bytes are their own halves.
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            # A token that its own bytes never merge to occurs only as a whole piece.
            if self.merged(token) == [rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """The merges one by one, lowest rank first: to learn how a token comes about."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            if len(parts) == 2:
                self.left[best], self.right[best] = (get(x) for x in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart when they stand side by side.

        Undoes their merges from the last one back. If at some stage the two tokens
        that meet would merge, and sooner than what was undone, they are not kept apart.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.KEEP_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._apart(left, right)
        return found

    def _apart(self, a: int, b: int) -> bool:
        tokens, get, undone = self.tokens, self.ranks.get, len(self.tokens)
        while True:
            joint = get(tokens[a] + tokens[b])
            if joint is not None and joint < undone:
                return False
            if self.lengths[a] == self.lengths[b] == 1:
                return True
            # The later merge is undone first; of two alike, the one on the right,
            # which the merges do after the one on the left.
            if self.lengths[b] == 1 or (self.lengths[a] > 1 and a > b):
                undone, a = a, self.right[a]
            else:
                undone, b = b + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, lengths = len(piece), self.lengths
        matches: list[list[int]] = [[] for _ in range(size)]
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            matches[end + 1 - lengths[token]].append(token)  # short ones first
        alive = bytearray(b"\1" * (size + 1))
        out: list[int] = []
        chosen: list[int] = []
        at, k = 0, len(matches[0]) - 1
        while at < size:
            here = matches[at]
            while k >= 0:
                token = here[k]
                if alive[at + lengths[token]] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                chosen.append(k)
                at += lengths[token]
                k = len(matches[at]) - 1 if at < size else -1
            else:
                if not out:
                    raise ValueError(f"the ranks can't express {piece[:80]!r}")
                alive[at] = 0
                at -= lengths[out.pop()]
                k = chosen.pop() - 1
        return out

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= self.KEEP_LENGTH:
            if len(self) >= self.KEEP:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.findall(text)))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    return Codec(path, pattern)


def bpe_encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of each whole text.

    Returns ``id``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit
    integers), a row for each row of ``df``, repeated ones and null ids included.
    A null text counts as empty and has no tokens. Other columns are not looked at.
    ``ranks_path`` is a tiktoken rank file that each executor can open, ``pattern``
    what splits a text into the pieces within which bytes are merged. Narrow: no
    shuffle, one pass, and a bounded memo of pieces in each worker.
    """
    picked = df.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(ranks_path, pattern)
        ids = [coder.encode(x.as_py() or "") for x in batch.column(1)]
        counts = pa.array([len(x) // 4 for x in ids], pa.int64())
        names = ["id", "n_tokens", "ids"]
        return pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names)

    return map_batches(picked, encode, f"id {kind}, n_tokens bigint, ids binary")


def bpe_decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded`` (binary): the bytes that its packed ids stand for.

    Null ids give null, no ids the empty string; an id that is not in the rank
    file raises.
    """

    @F.pandas_udf("binary")
    def decode(ids):
        tokens = tokens_of(ranks_path)
        return ids.map(lambda x: None if x is None else decode_ids(tokens, x))

    ship(df.sparkSession.sparkContext)
    return df.withColumn("decoded", decode(column(ids_col)))
