"""Ranked lexical search by scanning whole documents for the terms of all items.

The terms of the items, each between two guard characters, make one Aho-Corasick
automaton. Documents are read as bytes in which all that is not part of a term has
become a guard, so a match is a whole term, and matches of neighbours share the guard
between them. Term frequencies are counted from the text itself; there is no index of
documents and no shuffle of their words. One scan counts documents, lengths and the
documents of each term, a second one scores: each task keeps the best documents of each
item, and those of all tasks are ranked in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from tabflow.llm.shared import arrow_schema, column, map_arrow

GUARD = b" "
#: Each byte as the scan sees it: A-Z in lower case, and a guard for what is no part of a term.
SEEN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else GUARD[0] for c in range(256)
)
#: The same for Spark's regular expressions, after which a text is split at spaces.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the terms of one automaton, which every executor holds; more items make more scans.
BLOCK_BYTES = 4 << 20
#: In how many parts the best documents of an item are ranked first.
PARTS = 64


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``term`` (binary), each pair once. Rows of one item id count as one item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.regexp_replace(column(text_col), NO_TERM, " "), upper, upper.lower())
    terms = items.select(column(id_col).alias("item"), F.explode(F.split(text, " ")).alias("term"))
    return terms.where("term <> ''").select("item", F.col("term").cast("binary").alias("term")).distinct()


def blocks_of(terms: DataFrame, most: int) -> int:
    """In how many parts the items go, by hash, so that no part's terms exceed ``most``
    bytes: twice as many until each part keeps to it or is a single item."""
    sizes = terms.groupBy("item").agg(F.sum(F.length("term") + 2).alias("bytes"))
    blocks = 1
    while True:
        parts = sizes.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
        parts = parts.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"))
        if parts.where((F.col("bytes") > most) & (F.col("items") > 1)).isEmpty():
            return blocks
        blocks *= 2


class Scanner:
    """The automaton of a block of items, and which items each term belongs to."""

    def __init__(self, pairs: list[tuple[int, bytes]]):
        self.terms = sorted({term for _, term in pairs})
        self.automaton = ahocorasick.Automaton()
        number = {term: k for k, term in enumerate(self.terms)}
        for term, k in number.items():
            self.automaton.add_word((GUARD + term + GUARD).decode("latin-1"), k)
        self.automaton.make_automaton()
        # Items of term k: items[starts[k]:starts[k + 1]].
        order = sorted((number[term], item) for item, term in pairs)
        self.items = np.array([item for _, item in order], np.int64)
        counts = np.bincount([k for k, _ in order], minlength=len(self.terms))
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    def count(self, text: bytes) -> tuple[int, Counter]:
        """How many terms a text has, and how often each term of the items."""
        seen = (GUARD + text + GUARD).translate(SEEN)
        inside = np.frombuffer(seen, np.uint8) != GUARD[0]
        length = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        found = self.automaton.iter(seen.decode("latin-1")) if length and self.terms else ()
        return length, Counter(map(itemgetter(1), found))


def texts_of(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[bytes]:
    for batch in batches:
        for value in batch.column(at):
            yield value.as_py() or b""


def statistics(texts: DataFrame, pairs: list[tuple[int, bytes]]) -> tuple[int, int, list[int]]:
    """Documents with a term, all their terms, and for each term of the scanner its documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, documents, terms = Scanner(pairs), 0, 0
        holding = np.zeros(len(scanner.terms), np.int64)
        for text in texts_of(batches, 0):
            length, found = scanner.count(text)
            documents += length > 0
            terms += length
            holding[list(found)] += 1
        if documents:
            some = np.flatnonzero(holding)
            keys, values = [-2, -1, *some.tolist()], [documents, terms, *holding[some].tolist()]
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "v": pa.array(values, pa.int64())})

    counted = map_arrow(texts.select("text"), scan, "k bigint, v bigint")
    sums = {k: v for k, v in counted.groupBy("k").agg(F.sum("v")).collect()}
    size = len({term for _, term in pairs})
    return sums.pop(-2, 0), sums.pop(-1, 0), [sums.get(k, 0) for k in range(size)]


class Best:
    """The ``most`` best documents of each item so far: higher scores, then smaller ids, nulls last."""

    #: Candidates gathered before the worse ones go.
    ROOM = 200_000

    def __init__(self, items: int, most: int):
        self.most, self.waiting, self.size = most, [], 0
        self.least = np.ones(items, np.int64)  # a score under it is not among the best

    def add(self, doc_id: int | None, scores: np.ndarray) -> None:
        items = np.flatnonzero(scores >= self.least)
        null = doc_id is None
        self.waiting.append((items, scores[items], np.full(len(items), null), np.full(len(items), 0 if null else doc_id)))
        self.size += len(items)
        if self.size > self.ROOM + 2 * self.most * len(self.least):
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """The best as items, scores, whether the id is null, and ids."""
        if not self.waiting:
            return (np.zeros(0, np.int64),) * 4
        items, scores, null, ids = map(np.concatenate, zip(*self.waiting))
        order = np.lexsort((ids, null, -scores, items))
        items, scores, null, ids = items[order], scores[order], null[order], ids[order]
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        last = rank == self.most - 1
        self.least[items[last]] = scores[last]
        best = rank < self.most
        kept = items[best], scores[best], null[best], ids[best]
        self.waiting, self.size = [kept], len(kept[0])
        return kept


def search_block(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """The best documents of a block of items as ``item``, ``last`` (null id), ``doc``, ``score``."""
    rows = terms.orderBy("item", "term").collect()  # no more than BLOCK_BYTES, or one item
    ids = list(dict.fromkeys(row.item for row in rows))
    number = {item: k for k, item in enumerate(ids)}
    pairs = [(number[row.item], bytes(row.term)) for row in rows]
    documents, length, holding = statistics(texts, pairs)
    weights = np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding], np.int64
    )
    kind = terms.schema["item"].dataType.simpleString()
    schema = f"item {kind}, last boolean, doc bigint, score bigint"
    arrow = arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, best = Scanner(pairs), Best(len(ids), most)
        sizes = np.diff(scanner.starts)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = scanner.count(text.as_py() or b"")
                if not found:
                    continue
                m = 100 - 50 + (50 * n * documents) // length
                hits = np.fromiter(found.keys(), np.int64, len(found))
                tf = np.fromiter(found.values(), np.int64, len(found))
                parts = weights[hits] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                # The items of all hits side by side, and each hit's part of their scores.
                of = sizes[hits]
                at = np.repeat(scanner.starts[hits] - np.cumsum(of) + of, of) + np.arange(of.sum())
                # Sums in doubles are exact: each is under 2**53.
                scores = np.bincount(scanner.items[at], np.repeat(parts, of), len(ids))
                best.add(doc_id, scores.astype(np.int64))
        items, scores, null, docs = best.prune()
        columns = [
            pa.array([ids[k] for k in items.tolist()], arrow.field(0).type),
            pa.array(null, pa.bool_()),
            pa.array(docs, pa.int64(), mask=null.astype(bool)),
            pa.array(scores, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_arrow(texts.select("id", "text"), scan, schema)


def search(
    documents: DataFrame,
    items: DataFrame,
    most: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``most`` highest-scoring documents of each item, scores above 0 only.

    Returns ``item``, ``rank`` (from 1), ``doc`` and ``score``; equal scores by ascending
    id, null ids last. Terms are runs of ASCII letters and digits and of all characters
    from U+0080 on, A-Z lower-cased. Null and empty texts have no term; an item without
    terms, and one that no document shares a term with, has no rows. A repeated document
    is one more document; rows of one item id, null included, are one item with the terms
    of them all. ``id_col`` must be of an integral type. Other columns are not looked at.

    The items are the queries: they are dealt into blocks of at most ``block_bytes`` of
    terms (a single larger item is a block), and the documents are scanned twice for each,
    so that what an executor holds has a bound whatever the number of items. Tasks send
    on no more than ``most`` documents an item.
    """
    if not isinstance(documents.select(column(id_col)).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integral type")
    texts = documents.select(
        column(id_col).cast("bigint").alias("id"), column(text_col).cast("binary").alias("text")
    )
    terms = item_terms(items, item_col, item_text_col)
    blocks = blocks_of(terms, block_bytes)
    found = None
    for k in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        if k and block.isEmpty():
            continue
        best = search_block(texts, block, most)
        found = best if found is None else found.unionByName(best)

    def top(df: DataFrame, *keys: str) -> DataFrame:
        order = [F.col("score").desc(), "last", "doc"]
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where(F.col("rank") <= most)

    parts = found.withColumn("part", F.pmod(F.xxhash64("doc", "score"), F.lit(PARTS)))
    return top(top(parts, "item", "part"), "item").select("item", "rank", "doc", "score")
