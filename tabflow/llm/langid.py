"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is bound into one vector:
the letters' vectors, each rotated by its place, multiplied elementwise. The n-gram
vectors of a text, times their counts, are bundled (added) into the text's vector,
those of a language's texts into its prototype. A text has the language whose
prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabflow.llm.shared import arrow_schema, column, extend, map_arrow, spare_name

GAP = 32  # what stands for everything that is no letter
CHUNK = 1 << 20  # characters of a text looked at together
BLOCK = 4096  # n-gram vectors built at a time


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or ``GAP``."""
    table = np.full(0x110000, GAP, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@lru_cache(maxsize=65536)
def letter_vector(letter: int, dims: int) -> np.ndarray:
    return np.random.default_rng([letter, dims]).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)


def gram_counts(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed 21 bits a letter, and their counts.

    Runs of anything but letters count as one gap, and a gap stands before and after the text.
    """
    table = letter_table()
    tail = np.array([GAP], np.uint32)
    grams, counts = [], []
    for at in range(0, len(text), CHUNK):
        codes = table[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([tail, codes] + [np.array([GAP], np.uint32)] * (at + CHUNK >= len(text)))
        codes = codes[np.concatenate([[True], (codes[1:] != GAP) | (codes[:-1] != GAP)])]
        if len(codes) >= n:
            packed = np.zeros(len(codes) - n + 1, np.uint64)
            for k in range(n):
                packed = (packed << np.uint64(21)) | codes[k : k + len(packed)].astype(np.uint64)
            a, b = np.unique(packed, return_counts=True)
            grams.append(a)
            counts.append(b)
        tail = codes[-(n - 1) :] if n > 1 else codes[:0]
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(grams) == 1:
        return grams[0], counts[0]
    a, where = np.unique(np.concatenate(grams), return_inverse=True)
    return a, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def gram_vectors(grams: np.ndarray, n: int, dims: int) -> np.ndarray:
    """The bound vectors of packed n-grams, a row each."""
    out = np.ones((len(grams), dims), np.int8)
    for k in range(n):
        letters = ((grams >> np.uint64(21 * (n - 1 - k))) & np.uint64(0x1FFFFF)).astype(np.int64)
        distinct, where = np.unique(letters, return_inverse=True)
        # The rotation by its place tells a letter in front from the same one behind.
        rotated = np.stack([np.roll(letter_vector(int(x), dims), n - 1 - k) for x in distinct])
        out *= rotated[where]
    return out


def text_vectors(texts: list[str], n: int, dims: int) -> np.ndarray:
    """The bundled vector of each text, computed for all texts by one product a block."""
    found = [gram_counts(x, n) for x in texts]
    sizes = [len(a) for a, _ in found]
    out = np.zeros((len(texts), dims), np.float32)
    if not sum(sizes):
        return out
    rows = np.repeat(np.arange(len(texts)), sizes)
    grams, where = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
    counts = np.concatenate([c for _, c in found]).astype(np.float32)
    order = np.argsort(where, kind="stable")
    rows, where, counts = rows[order], where[order], counts[order]
    cuts = np.searchsorted(where, np.arange(0, len(grams) + BLOCK, BLOCK))
    for b, low in enumerate(range(0, len(grams), BLOCK)):
        part = grams[low : low + BLOCK]
        dense = np.zeros((len(texts), len(part)), np.float32)
        here = slice(cuts[b], cuts[b + 1])
        dense[rows[here], where[here] - low] = counts[here]
        out += dense @ gram_vectors(part, n, dims).astype(np.float32)
    return out


def groups(texts: list[str | None], chars: int = 1 << 20, most: int = 256) -> Iterator[slice]:
    """Slices of a batch with bounded numbers of texts and characters."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if i > start and (size > chars or i - start >= most):
            yield slice(start, i)
            start, size = i, 0
        size += len(x or "")
    if start < len(texts):
        yield slice(start, len(texts))


def train(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", n: int = 3, dims: int = 1024
) -> DataFrame:
    """A prototype for each language: ``lang``, ``prototype`` (array of doubles).

    All rows with a language and a text that has letters take part; their vectors
    are scaled to length 1, so that a long text counts no more than a short one.
    Each task adds up its own texts, and the sums of tasks are added per language
    and dimension, so what is shuffled depends on the numbers of tasks and
    languages only. No rows give no prototypes.
    """
    picked = df.select(column(lang_col).alias("lang"), column(text_col).alias("text"))
    picked = picked.where("lang IS NOT NULL AND text IS NOT NULL")
    schema = "lang string, part array<double>"
    kind = arrow_schema(schema)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in groups(texts):
                vectors = text_vectors(texts[s], n, dims).astype(np.float64)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                names, where = np.unique(np.array(langs[s], object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    sums[str(name)] = sums.get(str(name), 0) + vectors[where == k].sum(axis=0)
        if sums:
            columns = [pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()])]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    parts = map_arrow(picked, bundle, schema)
    return (
        parts.select("lang", F.posexplode("part").alias("k", "x"))
        .groupBy("lang", "k")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("kx"))
        .select("lang", F.col("kx.x").alias("prototype"))
        .where(F.exists("prototype", lambda x: x != 0))
    )


def predict(
    df: DataFrame,
    prototypes: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    dims: int = 1024,
    keep: tuple[str, ...] = (),
    most_languages: int = 10_000,
) -> DataFrame:
    """The language of each whole text.

    Returns ``id``, ``lang_pred``, ``score`` (the cosine, at least 0) and the
    columns named in ``keep``, a row for each row of ``df``. A null text, one
    without any letter, and any text when there is no prototype are ``und`` with
    score 0. Of languages that are equally near the first in the alphabet is taken.
    Prototypes go to the tasks as one array, which must have no more than
    ``most_languages`` rows. Narrow: no shuffle.
    """
    learned = sorted(
        (r["lang"], r["prototype"]) for r in prototypes.limit(most_languages + 1).collect()
    )
    if len(learned) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = [x for x, _ in learned]
    table = np.array([x for _, x in learned], np.float64).reshape(len(names), dims)
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    picked = df.select(
        column(id_col).alias("id"),
        column(text_col).alias(spare_name(keep)),
        *[column(c) for c in keep],
    )
    out = extend(picked.drop(picked.columns[1]).schema, "lang_pred string, score double")
    schema = arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for s in groups(texts):
                part = [x or "" for x in texts[s]]
                vectors = text_vectors(part, n, dims)
                norms = np.linalg.norm(vectors, axis=1)
                lettered = np.array([any(map(str.isalpha, x)) for x in part]) & (norms > 0)
                if len(names):
                    cosines = (vectors @ table.T) / np.maximum(norms, 1e-12)[:, None]
                    best = cosines.argmax(axis=1)
                    top = cosines[np.arange(len(part)), best].clip(0, 1)
                else:
                    lettered[:] = False
                for i, known in enumerate(lettered):
                    langs.append(names[best[i]] if known else "und")
                    scores.append(float(top[i]) if known else 0.0)
            kept = [batch.column(0), *batch.columns[2:], pa.array(langs), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) for x, f in zip(kept, schema)], schema=schema
            )

    return map_arrow(picked, score, out)
