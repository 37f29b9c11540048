"""Byte-pair encoding and decoding by a tokenization automaton.

The merges of a tokenizer file are compiled into one deterministic automaton whose arcs
are tokens and whose paths are exactly the token sequences that the merges give. It
begins as a single state with an arc for each byte. Each merge in turn is applied as a
gadget: what follows its left token becomes a state of its own, which loses the arc of
the right token, and the new token's arc is put beside each arc of the left token, to
where the right token's arc led. So the state after a token depends on that token alone,
and there are no more states than merges.

Arcs are numbered in such an order that those a gadget takes away are neighbours, and
a state is a short table of the ranges of numbers that it lacks. To encode, the arcs
are followed byte by byte: the arcs that are under way at one place are one state of a
table, whose entries are worked out when they are first met and looked up from then on.
One token ends at each place, as each beginning of a word has one encoding; those that
lead to the word's end are the result. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabflow.llm.bpe import split_pattern
from tabflow.llm.shared import arrow_schema, column, extend, map_batches


def byte_letters() -> dict[str, int]:
    """The visible character that byte-level files write for each byte: printable
    Latin-1 for itself, and the rest numbered from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """What a tokenizer file holds: labels (bytes) by id, merges as ids, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before = whole["model"], whole["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not whole["normalizer"] and before.get("type") == "ByteLevel"
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if not plain or before.get("add_prefix_space") or any(model.get(k) for k in odd):
            raise ValueError(f"{path}: only plain byte-level merges are supported")
        vocab, letters = model["vocab"], byte_letters()
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        if any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take their surroundings are not supported")
        self.added = added
        self.labels = read_labels(path)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.letters = [vocab.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        if None in self.letters:
            raise ValueError(f"{path}: a byte has no token")
        known = set(self.letters)
        for u, v, w in self.rules:
            if u not in known or v not in known or w in known:
                raise ValueError(f"{path}: a merge must join known tokens to a new one")
            known.add(w)


def read_labels(path: str) -> list[bytes]:
    """The label of each id."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    letters, added = byte_letters(), {t["content"]: t["id"] for t in whole["added_tokens"]}
    vocab = whole["model"]["vocab"]
    found = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for token, k in vocab.items():
        found[k] = bytes(map(letters.__getitem__, token))
    for token, k in added.items():
        found[k] = token.encode()
    return found


class Automaton:
    """The compiled automaton: ``state_of`` a token's arc leads to, and for each state
    the first and last numbers of the ranges of arcs that it lacks."""

    def __init__(self, merges: Merges):
        self.labels = merges.labels
        size = len(merges.labels)
        # A state: the one it was split from, at which merge, and the arcs taken since.
        parents, made, taken, users = [-1], [-1], [{}], [0]
        state_of, head, born = [-1] * size, [-1] * size, [-1] * size
        beside: list[list[int]] = [[] for _ in range(size)]
        for letter in merges.letters:
            state_of[letter] = 0

        def has(state: int, arc: int) -> bool:
            """Whether a state still has an arc, which may have gone with one it stood beside."""
            limit = len(merges.rules)
            while state >= 0:
                token, until = arc, limit
                while token >= 0:
                    at = taken[state].get(token)
                    if at is not None and at < until:
                        return False
                    # ">=" for a token merged with itself, whose merge is gone as well
                    if at is not None and at == until and beside_self[at]:
                        return False
                    token, until = head[token], min(until, born[token])
                limit, state = min(limit, made[state]), parents[state]
            return True

        beside_self = [u == v for u, v, _ in merges.rules]
        for r, (u, v, w) in enumerate(merges.rules):
            if state_of[u] < 0 or state_of[v] < 0 or not has(state_of[u], v):
                continue  # tokens that never meet: no arc, and none for what is made of them
            beside[u].append(w)
            head[w], born[w] = u, r
            old = state_of[u]
            state_of[w] = state_of[v]
            users[state_of[v]] += 1
            if old == 0 or users[old] > 1 or u == v:
                users[old] -= 1
                parents.append(old)
                made.append(r)
                taken.append({})
                users.append(1)
                state_of[u] = len(parents) - 1
            taken[state_of[u]][v] = r
        self.state_of = state_of

        # Numbers: a token, then those beside it, the latest first, each with its own.
        first, last, n = [0] * size, [0] * size, 0
        for letter in merges.letters:
            stack = [(letter, 0)]
            while stack:
                token, k = stack.pop()
                if k == 0:
                    first[token] = n
                    n += 1
                if k < len(beside[token]):
                    stack.append((token, k + 1))
                    stack.append((beside[token][-1 - k], 0))
                else:
                    last[token] = n
        self.number = first

        def gone(token: int, at: int) -> tuple[int, int]:
            """The numbers of a token and of those put beside it after a merge."""
            ranks = [born[w] for w in beside[token]]
            k = bisect_left(ranks, at) if beside_self[at] else bisect_right(ranks, at)
            return first[token], last[beside[token][k]] if k < len(ranks) else first[token] + 1

        self.starts, self.ends, self.bounds = array("i"), array("i"), array("i", [0])
        for state in range(len(parents)):
            ranges, limit = [], len(merges.rules)
            while state >= 0:
                ranges += [gone(v, r) for v, r in taken[state].items() if r < limit]
                limit, state = min(limit, made[state]), parents[state]
            end = -1
            for a, b in sorted(ranges):
                if a >= end:  # else inside the one before
                    self.starts.append(a)
                    self.ends.append(b)
                    end = b
            self.bounds.append(len(self.starts))

        # The bytes of the arcs as a tree: node and byte to node; the token that ends at it.
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        for token in range(size):
            if state_of[token] >= 0:
                node = 0
                for byte in merges.labels[token]:
                    node = self.step.setdefault(node << 8 | byte, len(self.token_at))
                    if node == len(self.token_at):
                        self.token_at.append(-1)
                self.token_at[node] = token
        self.inner = {key >> 8 for key in self.step}
        self.lengths = np.array(list(map(len, merges.labels)), np.int64)
        self.forget()

    #: Entries of the byte table at which it is begun anew, and its places at first.
    KEEP_STEPS, PLACES = 400_000, 1 << 20
    #: Bytes from which a word is followed on its own.
    LONG = 64

    def forget(self) -> None:
        """An empty table, with the row at which a word begins. It is open hashing in two
        arrays: keys (a row and a byte) and entries (the next row, and a token)."""
        self.places = self.PLACES
        self.keys = np.full(self.places, -1, np.int64)
        self.entries = np.full(self.places, -1, np.int64)
        begin = array("Q", [0]).tobytes()
        self.row_of, self.rows, self.steps = {begin: 0}, [begin], 0

    def follow(self, key: int) -> int:
        """A new entry of the table: the row after a row and a byte, times 2**32, and the
        token that ends there. A row stands for a state reached and the arcs begun before:
        the states they leave and how far their bytes have come."""
        before = array("Q")
        before.frombytes(self.rows[key >> 8])
        byte, found, on, step, inner = key & 255, -1, array("Q", [0]), self.step.get, self.inner
        for x in (*before[1:], before[0] << 32):
            start, node = x >> 32, step((x & 0xFFFFFFFF) << 8 | byte)
            if node is not None:
                token = self.token_at[node]
                if token >= 0:
                    arc, low = self.number[token], self.bounds[start]
                    k = bisect_right(self.starts, arc, low, self.bounds[start + 1]) - 1
                    if k < low or arc >= self.ends[k]:
                        found = token
                if node in inner:
                    on.append(start << 32 | node)
        on[0] = self.state_of[found]
        after = on.tobytes()
        row = self.row_of.setdefault(after, len(self.rows))
        if row == len(self.rows):
            self.rows.append(after)
        entry = row << 32 | found
        self.steps += 1
        if 2 * self.steps > self.places:
            # More than half full within one call of encode, which needs all of its entries.
            old = self.keys[self.keys >= 0], self.entries[self.keys >= 0]
            self.places *= 2
            self.keys = np.full(self.places, -1, np.int64)
            self.entries = np.full(self.places, -1, np.int64)
            for k, e in zip(*map(np.ndarray.tolist, old)):
                place = self.place(k)
                self.keys[place], self.entries[place] = k, e
        place = self.place(key)
        self.keys[place], self.entries[place] = key, entry
        return entry

    def place(self, key: int) -> int:
        """Where a key is, or may be put."""
        at = ((key * self.SPREAD & (1 << 64) - 1) >> 32) % self.places
        while self.keys[at] not in (key, -1):
            at = (at + 1) % self.places
        return at

    #: An odd number of 64 bits, by which keys are spread over the places.
    SPREAD = 0x9E3779B97F4A7C15

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The entries of keys; those that are new are worked out."""
        at = (keys.astype(np.uint64) * np.uint64(self.SPREAD) >> np.uint64(32)).astype(np.int64) % self.places
        there = self.keys[at]
        wrong = np.flatnonzero((there != keys) & (there != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % self.places
            there[wrong] = self.keys[at[wrong]]
            wrong = wrong[(there[wrong] != keys[wrong]) & (there[wrong] != -1)]
        out = self.entries[at]
        new = np.flatnonzero(there == -1)
        if len(new):
            distinct, of = np.unique(keys[new], return_inverse=True)
            out[new] = np.array([self.follow(key) for key in distinct.tolist()])[of]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the tokens of the only path that spells it: their number, and all
        of them one word after the other. The words are followed side by side."""
        if self.steps > self.KEEP_STEPS:
            self.forget()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        into = np.zeros(len(text), np.int64)  # the token that ends at each byte
        order = np.argsort(-sizes, kind="stable")
        order = order[np.count_nonzero(sizes > self.LONG) :]
        rows, k = np.zeros(len(order), np.int64), 0
        while len(order := order[: np.count_nonzero(sizes[order] > k)]):
            at = starts[order] + k
            entries = self.look_up(rows[: len(order)] << 8 | text[at])
            into[at], rows, k = entries & 0xFFFFFFFF, entries >> 32, k + 1
        for word in np.flatnonzero(sizes > self.LONG).tolist():
            row = 0
            for at, byte in enumerate(words[word], int(starts[word])):
                key = row << 8 | byte
                place = self.place(key)
                entry = int(self.entries[place]) if self.keys[place] == key else self.follow(key)
                into[at], row = entry & 0xFFFFFFFF, entry >> 32
                if self.steps > self.KEEP_STEPS:
                    state = self.rows[row]  # the word goes on from here in a new table
                    self.forget()
                    row = self.row_of.setdefault(state, len(self.rows))
                    if row:
                        self.rows.append(state)
        # Back from the end of each word, token by token.
        ends = np.zeros(len(text), bool)
        place = (starts + sizes)[sizes > 0] - 1
        first = starts[sizes > 0]
        while len(place):
            ends[place] = True
            place = place - self.lengths[into[place]]
            place, first = place[place >= first], first[place >= first]
        counts = np.add.reduceat(np.append(ends, False), starts) if len(words) else np.zeros(0, np.int64)
        return np.where(sizes > 0, counts, 0), into[ends].astype("<u4")


class Encoder:
    """The automaton of a tokenizer file, with a memo of encoded words."""

    #: Words in the memo at which it is begun anew, and characters encoded at a time.
    KEEP, PIECE = 200_000, 1 << 20

    def __init__(self, path: str, pattern: str):
        merges = Merges(path)
        self.automaton = Automaton(merges)
        self.findall = split_pattern(pattern).findall
        self.added = {t: merges.added[t] for t in sorted(merges.added, key=len, reverse=True)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        """An empty memo: the number of each word, and of the words by number their tokens."""
        self.word: dict[str, int] = {}
        self.counts, self.tokens = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def words(self, text: str) -> list[str]:
        if self.cut and any(t in text for t in self.added):
            parts = self.cut.split(text)  # at odd places added tokens, marked as no word can be
            return [w for k, x in enumerate(parts) for w in (["\0" + x] if k % 2 else self.findall(x))]
        return self.findall(text)

    def learn(self, words: list[str]) -> None:
        """Put new words into the memo."""
        marked = [w for w in words if w[1:] in self.added and w[0] == "\0"]
        plain = [w for w in words if not (w[1:] in self.added and w[0] == "\0")] if marked else words
        counts, tokens = self.automaton.encode([w.encode() for w in plain])
        own = np.array([self.added[w[1:]] for w in marked], "<u4")
        self.word |= {w: k for k, w in enumerate([*plain, *marked], len(self.word))}
        self.counts = np.concatenate([self.counts, counts, np.ones(len(own), np.int64)])
        self.tokens = np.concatenate([self.tokens, tokens, own])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of ids, and all ids one text after the other."""
        done, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > self.PIECE:
                done.append(self.encode_some(some))
                some, size = [], 0
        done.append(self.encode_some(some))
        return tuple(map(np.concatenate, zip(*done)))

    def encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.words, texts))
        words = list(chain.from_iterable(split))
        new = set(words).difference(self.word)
        if len(self.word) + len(new) > self.KEEP:
            self.forget()
            new = set(words)
        if new:
            self.learn(list(new))
        number = np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))
        counts = self.counts[number]
        before = np.cumsum(counts)
        starts = np.cumsum(self.counts) - self.counts
        at = np.repeat(starts[number] - before + counts, counts)
        ids = self.tokens[at + np.arange(len(at))]
        upto = np.append(0, before)[np.cumsum([0, *map(len, split)])]
        return np.diff(upto), ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a tokenizer file, compiled once in each worker."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def labels(path: str) -> list[bytes]:
    """The label of each id, which is all that decoding takes."""
    return read_labels(path)


def text_of(label: list[bytes], ids: np.ndarray) -> str:
    """The labels of ids, one after the other, as text."""
    return b"".join(map(label.__getitem__, ids.tolist())).decode("utf-8", "replace")


def automaton_encode(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """Token ids of each whole text, as the tokenizers library gives them without adding
    special tokens; those that a text spells out become their ids.

    Returns ``id``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit integers),
    a row for each row of ``df``, repeated ones and null ids included. A null text counts
    as empty and has no tokens. Other columns are not looked at. ``path`` is a tokenizer
    file of byte-level merges that each executor can open, without normalizer or prefix
    space (others raise); ``pattern`` is what splits a text into words. Narrow: no
    shuffle, one pass, and a bounded memo of words in each worker. With ``decoded`` the
    same pass decodes the ids, into a column as :func:`automaton_decode` adds.
    """
    picked = df.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        coder = encoder(path, pattern)
        counts, ids = coder.encode(texts)
        ends = pa.py_buffer(np.append(0, np.cumsum(4 * counts)).astype(np.int32).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, ends, pa.py_buffer(ids.tobytes())])
        columns = [batch.column(0), pa.array(counts, pa.int64()), packed]
        if decoded:
            upto = np.cumsum(counts)
            parts = (ids[b - n : b] for n, b in zip(counts.tolist(), upto.tolist()))
            columns.append(pa.array([text_of(coder.automaton.labels, x) for x in parts], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_tokens", "ids", "decoded"][: 3 + decoded]
    schema = f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded
    return map_batches(picked, encode, schema)


def automaton_decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded`` (string): the labels of its packed ids, one after
    the other, as UTF-8 text; bytes that are no UTF-8 become U+FFFD. Null ids give null,
    no ids the empty string; an id that the file has no label for raises."""

    out = extend(df.schema, "decoded string")
    at, arrow = df.columns.index(ids_col), arrow_schema(out)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = labels(path)
        packed = [None if x is None else np.frombuffer(x, "<u4") for x in batch.column(at).to_pylist()]
        texts = [None if x is None else text_of(known, x) for x in packed]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=arrow)

    return map_batches(df, decode, out)
