"""Quality rules whose thresholds adapt to each language and source.

The measures of a text go into quantile sketches of logarithmic buckets, which are
merged by adding up counts and hold each quantile within a relative error. From the
sketch of each language and source comes the limit of each measure, and rows are
filtered by a join with these limits. Built of DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabflow.llm.shared import column, materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
GRAM = 8
#: Measures for which more is worse, as shares of a text's words, lines or characters.
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
#: Relative width of a bucket, and what counts as zero.
WIDTH, TINY = 1.02, 1e-6


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of ``GRAM`` words that occur twice or more."""
    size = F.size(words)
    hashes = F.when(
        size >= GRAM,
        F.transform(F.sequence(F.lit(1), size - (GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, GRAM))),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        spans = let(
            starts,
            lambda s: F.transform(
                s, lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(s, k + 1) - x, F.lit(GRAM)))
            ),
        )
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, x: total + x)

    found = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    )
    return F.coalesce(found, F.lit(0)).cast("bigint")


def measure(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``id``, ``lang``, ``source``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_lines`` (not blank), ``n_dup_lines``, ``n_repeat_words`` of each whole text; a
    null text has no words.

    A window's words are compared by a 64-bit hash within one text. Narrow: one scan.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    words = df.select(
        column(id_col).alias("id"),
        column(lang_col).alias("lang"),
        column(source_col).alias("source"),
        text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return words.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def shares(measured: DataFrame) -> DataFrame:
    """The measures that limits are set for, next to the counts."""
    chars, words, lines = (F.greatest(c, F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    return measured.withColumns(
        {
            "symbol_share": F.col("n_symbols") / chars,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / words,
            "word_length": F.col("word_chars") / words,
        }
    )


def bucket(value: Column) -> Column:
    """The bucket of a value that isn't negative; about zero has bucket null."""
    return F.when(value > TINY, F.ceil(F.log(value) / math.log(WIDTH)).cast("int"))


def sketches(shared: DataFrame, *keys: str) -> DataFrame:
    """Merged quantile sketches: the ``n`` rows of each key, ``measure`` and ``bucket``.

    A row for each bucket in use, a few hundred per key at most; task sums are
    merged by addition, so a hot key reaches its reducer as one row per task.
    """
    long = shared.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
        ).alias("x"),
    )
    return long.groupBy(*keys, "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def quantile(sketch: DataFrame, share: float, *keys: str) -> DataFrame:
    """The value at ``share`` of each key and measure: upper end of the bucket in which
    the row at rank ``ceil(share * rows)`` lies, 0 for that of zero. Also ``rows``."""
    up = Window.partitionBy(*keys, "measure").orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketch.select(
        *keys,
        "measure",
        "bucket",
        F.sum("n").over(up).alias("upto"),
        F.sum("n").over(Window.partitionBy(*keys, "measure")).alias("rows"),
    )
    reached = ranked.where(F.col("upto") >= F.ceil(F.col("rows") * share))
    return reached.groupBy(*keys, "measure").agg(
        F.first("rows").alias("rows"),
        F.min(F.coalesce(F.pow(F.lit(WIDTH), F.col("bucket")), F.lit(0.0))).alias("q"),
    )


def limits(
    shared: DataFrame, share: float, slack: dict[str, tuple[float, float]], least_rows: int
) -> DataFrame:
    """A limit per language, source and measure, in one column per measure.

    The limit is the quantile at ``share`` times a factor plus a margin
    (``slack``). The quantile is the mean of a language and source's own and that of the
    whole language, weighted by their rows against ``least_rows``; that of the language is
    the mean of its own and that of all rows in the same way. So small groups take after
    larger ones, without a step at any number of rows.
    """
    fine = materialise(sketches(shared, "lang", "source"))
    broad = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = fine.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    own = quantile(fine, share, "lang", "source")
    lang = quantile(broad, share, "lang").select(
        F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("rows").alias("l_rows"), F.col("q").alias("l_q")
    )
    every = quantile(whole, share).select(F.col("measure").alias("e"), F.col("q").alias("e_q"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(
        every, F.col("measure") == F.col("e")
    )
    lang_q = (F.col("l_rows") * F.col("l_q") + least_rows * F.col("e_q")) / (F.col("l_rows") + least_rows)
    chosen = (F.col("rows") * F.col("q") + least_rows * lang_q) / (F.col("rows") + least_rows)
    return joined.groupBy("lang", "source").agg(
        *[
            F.max(F.when(F.col("measure") == m, chosen * slack[m][0] + slack[m][1])).alias(f"{m}_limit")
            for m in MEASURES
        ]
    )


#: For each measure the factor and margin on top of its quantile.
SLACK = {
    "symbol_share": (2.0, 0.01),
    "dup_line_share": (2.0, 0.1),
    "repeat_share": (1.5, 0.1),
    "word_length": (1.5, 0.0),
}
#: Counts up to which a measure rejects nothing: one repeated line, of 20 words at most.
ALLOWED = {"dup_line_share": ("n_dup_lines", 1), "repeat_share": ("n_repeat_words", 40)}


def adaptive_quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    share: float = 0.75,
    slack: dict[str, tuple[float, float]] = SLACK,
    least_rows: int = 200,
    least_words: int = 20,
    most_repeated: int = 30,
) -> DataFrame:
    """The verdict on each row of ``df``.

    Returns ``id``, the counts of :func:`measure`, ``base_failed`` (fewer words than
    ``least_words``, or more than ``most_repeated`` of 100 words repeated) and
    ``kept``: not failed, and no measure above its limit (of repetition only from a
    least count on, ``ALLOWED``). Null texts fail. Null
    languages and sources are keys like others. The measures are written to shared
    storage once; the join with the limits is on narrow rows, of which adaptive
    execution splits those of a hot source.
    """
    measured = materialise(measure(df, id_col, text_col, lang_col, source_col))
    shared = shares(measured)
    bounds = limits(shared, share, slack, least_rows).withColumnsRenamed({"lang": "l", "source": "s"})
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")
    )
    over = F.lit(False)
    for m in MEASURES:
        count, allowed = ALLOWED.get(m, ("n_words", 0))
        over = over | ((F.col(m) > F.col(f"{m}_limit")) & (F.col(count) > allowed))
    joined = shared.join(
        bounds, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    )
    return joined.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~over).alias("kept"),
    )
