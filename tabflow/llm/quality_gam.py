"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at its quantiles and has a lookup table of bins; so
have a few pairs of features. The tables are learned by boosting that goes round
the features in a cycle and adds a shallow tree over one feature's (or one pair's)
bins at a time. A text's score is the logistic of the sum of its bins' entries.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabflow.llm.shared import column, extend, map_batches, spare_name

FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "shout_share", "repeat_share",
    "distinct_share", "dup_line_share", "digit_share", "punct_share", "line_words",
    "top_share", "stop_share", "bare_share",
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(chars.encode("latin-1"), np.uint8)] = 1
    return out


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _mask("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC0:] = 1  # first bytes of characters beyond ASCII, taken as letters
_SYMBOL, _SHOUT, _DIGIT = _mask("#*$%&|<>"), _mask("!?"), _mask("0123456789")
_PUNCT = _mask("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_COUNTED = np.stack([_UPPER, _LETTER, _SYMBOL, _SHOUT, _DIGIT, _PUNCT], axis=1)


def features(text: str | None) -> list[float]:
    """The features of a whole text; a null text counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.zeros(256)
    for at in range(0, len(data), 1 << 22):
        seen += np.bincount(np.frombuffer(data[at : at + (1 << 22)], np.uint8), minlength=256)
    upper, letters, symbols, shouts, digits, puncts = (seen @ _COUNTED).tolist()
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    stops = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    bare = sum(map((b"|", b"-", b"*", b"#").__contains__, words))
    return [
        math.log1p(n),
        chars / n,
        upper / max(letters, 1),
        symbols / chars,
        shouts / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(counts) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        digits / chars,
        puncts / chars,
        math.log1p(n / max(len(lines), 1)),
        max(counts.values()) / n,
        stops / n,
        bare / n,
    ]


@dataclass
class Gam:
    """Lookup tables per feature and pair of features."""

    cuts: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # of each feature: bin -> bin of pair tables
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-total.clip(-30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> int | None:
    """Where to split a run of bins so that the two leaves fit best; None: nowhere."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else None


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf values of a shallow tree over the bins of one feature."""
    at = _cut(g, h, least) if depth else None
    if at is None:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, least), _tree(g[at:], h[at:], depth - 1, least)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """A tree of one split on the first feature and one on the second in each half."""
    at = _cut(g.sum(axis=1), h.sum(axis=1), least)
    out = np.empty_like(g)
    for rows in [slice(None)] if at is None else [slice(0, at), slice(at, None)]:
        out[rows] = _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 1, least)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15,
    most_bins: int = 48, pair_bins: int = 8, n_pairs: int = 6, depth: int = 2, least: float = 0.5,
) -> Gam:
    """Learn the tables. No rows give score 0.5, one label alone its smoothed share."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    share = (y.sum() + 1) / (n + 2)
    model = Gam(cuts, math.log(share / (1 - share)), [np.zeros(len(c) + 1) for c in cuts])
    model.coarse = [np.arange(len(c) + 1) * pair_bins // (len(c) + 1) for c in cuts]
    if not n or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(n, model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _tree(
                np.bincount(b[:, j], g, size), np.bincount(b[:, j], h, size), depth, least
            )
            model.tables[j] += step
            total += step[b[:, j]]
    coarse = np.stack([model.coarse[j][b[:, j]] for j in range(width)], axis=1)

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * pair_bins + coarse[:, j], values, pair_bins**2).reshape(pair_bins, -1)

    g, h = slopes()
    gains = sorted(
        (-float((grid(i, j, g) ** 2 / (grid(i, j, h) + 1)).sum()), i, j)
        for i in range(width)
        for j in range(i + 1, width)
    )
    model.pairs = [(i, j) for _, i, j in gains[:n_pairs]]
    model.grids = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), least)
            model.grids[k] += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", most_rows: int = 20_000,
) -> Gam:
    """Learn from the rows of ``df`` that have a 0 or 1 in ``labels``.

    At most ``most_rows`` labels are used, those with the smallest hash of their id;
    that bound also makes it safe to broadcast them to the scan of ``df`` and to
    bring their features to the driver. Null ids and labels are left out.
    """
    order = F.xxhash64(F.col("label_id").cast("string"))
    chosen = labels.select(column(id_col).alias("label_id"), column(label_col).alias("y"))
    chosen = chosen.where("label_id IS NOT NULL AND y IN (0, 1)").distinct()
    # Thinned out by hash before the sort, to which each task would bring the full number.
    share = 1.2 * most_rows / max(chosen.count(), 1)
    if share < 1:
        chosen = chosen.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    chosen = chosen.orderBy(order, "label_id", "y").limit(most_rows)
    rows = df.select(column(id_col).alias("id"), column(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(v.as_py()) for v in batch.column(1)], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), found], names=["y", "x"])

    pairs = map_batches(
        rows.select(F.col("y").cast("int").alias("y"), "text"), measure, "y int, x array<double>"
    )
    # Repeated rows of one id could exceed the bound.
    table = pairs.orderBy(F.xxhash64("x"), "y").limit(most_rows).toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(table["y"].to_pylist(), float))


def quality_scores(
    df: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), threshold: float = 0.5,
) -> DataFrame:
    """The score of each whole text.

    Returns ``id``, ``score`` (probability of label 1), ``predicted`` (1 from
    ``threshold`` on) and the columns named in ``keep``, a row for each row of
    ``df``. Null and empty texts are scored by features that are all 0. Narrow: the
    tables, a few thousand numbers, go to the tasks with the code.
    """
    picked = df.select(
        column(id_col).alias("id"),
        column(text_col).alias(spare_name(keep)),
        *[column(c) for c in keep],
    )
    out = extend(picked.drop(picked.columns[1]).schema, "score double, predicted int")
    names = out.fieldNames()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(v.as_py()) for v in batch.column(1)], float)
        scores = model.score(x)
        predicted = pa.array((scores >= threshold).astype(np.int32))
        kept = [batch.column(0), *batch.columns[2:], pa.array(scores), predicted]
        return pa.RecordBatch.from_arrays(kept, names=names)

    return map_batches(picked, run, out)
