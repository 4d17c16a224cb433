"""Quality rules whose cut-offs follow the corpus.

Every document gets word, symbol, line and repetition counts. For each language and source a quantile
sketch of every ratio is built: counts of logarithmic buckets, so a quantile is off by a hundredth of
its value at most, sketches merge by adding up, and every run gives the same. A source's quantiles
are averaged with those of its language, these with those of all rows, and these with fixed ones of
plain prose, with the numbers of rows as weights against PRIOR: small groups lean on the larger ones, and
no size switches a rule on or off. A ratio is bad if it lies far outside the spread between the median
and the quartile, and beyond a floor that protects uniform sources. The cut-offs are then joined to
the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import stored, table

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows that the wider group's quantiles count for beside those of a source, of a language, and of all rows.
PRIOR = (20, 200, 2000)
#: Quotient of the bounds of a sketch's bucket: its middle is off by one per cent at most.
GAMMA = 1.01 / 0.99
QUANTILES = (0.25, 0.5, 0.75)
#: The bucket of zeros, below all others.
EMPTY = -(1 << 30)
#: Times the distance from median to quartile that a ratio may lie beyond the median.
SPREAD = 6.0
#: name: (numerator, denominator, least allowance above the median, least allowance below it or None).
RATIOS = {
    "symbols": ("n_symbols", "n_words", 0.2, None),
    "dup_lines": ("n_dup_lines", "n_lines", 0.3, None),
    "upper": ("n_upper", "word_chars", 0.3, None),
    "word_length": ("word_chars", "n_words", 6.0, 2.5),
}
#: Quantiles of plain prose.
PLAIN = {"symbols": (0.0, 0.0, 0.0), "dup_lines": (0.0, 0.0, 0.0), "upper": (0.05, 0.05, 0.05), "word_length": (5.0, 5.0, 5.0)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that occur twice or more, the first one included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    names = ids
    for step in range(1, WINDOW):  # windows of one word more get exact names from those of one less
        pairs = names[:-1] * n + ids[step:]
        _, names, seen = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(seen) == len(pairs):
            return 0
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(seen[names] > 1)
    steps[at] += 1
    steps[at + WINDOW] -= 1
    return int((np.cumsum(steps)[:n] > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text; words are separated by space and bytes 9 to 13."""
    text = text or b""
    words = text.split()
    n = len(words)
    points = len(text.decode("utf-8", "replace"))
    word_chars = points - (len(text) - len(text.translate(None, SPACES)))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    n_upper = len(text) - len(text.translate(None, UPPER))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = repeated_words(words)
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), n_upper


def counts(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the columns ``kept``), ``lang``, ``source`` and the COUNTS (long) of every whole text.

    Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3).cast(pa.binary())
            found = np.array([text_counts(t.as_py()) for t in text], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch(
                [*batch.columns[:3], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["row", "lang", "source", *COUNTS]
            )

    rows = docs.select(
        F.struct(*kept).alias("row"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _ratio(name: str) -> Column:
    top, bottom, _, _ = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))


def sketches(counted: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``ratio``, ``bucket``, ``n``: the rows in each logarithmic bucket; 0 has a bucket of its own."""
    named = F.explode(F.create_map(*[x for r in RATIOS for x in (F.lit(r), _ratio(r))]))
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.lit(math.log(GAMMA))).cast("int"))
    return (
        counted.where("n_words > 0")
        .select("lang", "source", named.alias("ratio", "x"))
        .where("x is not null")
        .groupBy("lang", "source", "ratio", F.coalesce(bucket, F.lit(EMPTY)).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, ``ratio``, ``n`` and ``q`` (the QUANTILES) of the merged sketches of each group."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")  # as many rows as buckets: some thousand
    ranked = merged.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    value = F.when(F.col("bucket") == EMPTY, 0.0).otherwise(F.lit(2 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket")))
    least = [F.min(F.when(F.col("up_to") >= F.lit(p) * F.col("total"), value)) for p in QUANTILES]
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("n"), F.array(*least).alias("q"))


def _leaning(level: int, own: str, wide: Column) -> Column:
    """Quantiles of ``n`` rows averaged with those of the wider group."""
    n, prior = F.col("n"), F.lit(PRIOR[level])
    return F.zip_with(own, wide, lambda a, b: (a * n + b * prior) / (n + prior))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """``lang``, ``source`` and the cut-offs of each ratio that hold there: one row per pair that occurs."""
    plain = F.create_map(*[x for r, q in PLAIN.items() for x in (F.lit(r), F.array(*map(F.lit, q)))])
    every = quantiles(sketch, ()).select(F.col("ratio").alias("r0"), _leaning(2, "q", plain[F.col("ratio")]).alias("q0"))
    langs = quantiles(sketch, ("lang",)).join(every, F.col("ratio") == F.col("r0"))
    langs = langs.select(F.col("lang").alias("of"), F.col("ratio").alias("r1"), _leaning(1, "q", F.col("q0")).alias("q1"))
    own = quantiles(sketch, ("lang", "source")).join(langs, F.col("lang").eqNullSafe(F.col("of")) & (F.col("ratio") == F.col("r1")))
    q = _leaning(0, "q", F.col("q1"))
    found = []
    for name, (_, _, above, below) in RATIOS.items():
        high = q[1] + F.greatest(F.lit(above), (q[2] - q[1]) * SPREAD)
        found.append(F.max(F.when(F.col("ratio") == name, high)).alias(f"{name}_high"))
        if below is not None:
            low = q[1] - F.greatest(F.lit(below), (q[1] - q[0]) * SPREAD)
            found.append(F.max(F.when(F.col("ratio") == name, low)).alias(f"{name}_low"))
    return own.groupBy("lang", "source").agg(*found)


def verdicts(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``. Rows without words have no ratio and fail the base rule."""
    bad = F.lit(False)
    for name, (_, _, _, below) in RATIOS.items():
        bad = bad | F.coalesce(_ratio(name) > F.col(f"{name}_high"), F.lit(False))
        if below is not None:
            bad = bad | F.coalesce(_ratio(name) < F.col(f"{name}_low"), F.lit(False))
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (
        counted.join(
            limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~bad)
        .select("row", *COUNTS[:5], "base_failed", "kept")
    )


def quality(docs: DataFrame) -> DataFrame:
    """One verdict per row of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``).

    Null or empty texts have no words and fail. Null languages and sources form groups of their own. Rows that
    repeat an id or have none are judged one by one; other columns don't matter.
    """
    counted = stored(counts(docs), "counts")
    limits = stored(cutoffs(sketches(counted)), "cutoffs")
    return verdicts(counted, limits).select("row.doc_id", *COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were. Texts aren't shuffled for it: they are counted twice."""
    limits = stored(cutoffs(sketches(counts(docs))), "cutoffs")
    return verdicts(counts(docs, tuple(docs.columns)), limits).where("kept").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    return quality(table(spark, sf_dir, "documents"))
