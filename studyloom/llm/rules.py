"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Per document the measures are counted; per (language, source) a KLL sketch of each measure is built with partial
aggregation, so a group that holds a third of all rows is sketched in every map task and only sketches are
shuffled. Groups that are too small to trust take the merged sketch of their language, and then of all rows.
The fence of a measure is q75 + 3 * max(q75 - q25, least spread): what stands far outside of its own group fails.

Defined results: null text counts as empty and fails the base rules; null languages and sources are groups of
their own; repeated rows are judged one by one; an empty table gives an empty result; columns of any name come back,
those named like a count or a verdict are replaced by it. The step from a group's own sketch to its language's is a
rule for small groups, not for small tables: below min_group base-passing rows quartiles are too uncertain to reject by.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import append, cut, small_side, utf8, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SKETCH_K = 1024
#: Documents below which a group takes the thresholds of the next wider one.
MIN_GROUP = 50
FENCE = 3.0
#: Measures with the least spread that counts as one.
MEASURES = {"symbol_share": 0.05, "word_length": 2.0, "mark_share": 0.08, "upper_share": 0.1, "dup_line_share": 0.2}
MAX_BROADCAST_GROUPS = 20_000

_UPPER = bytes(range(65, 91))
_MARKS = b"!?;:\"'()[]{}=+~^`_/\\@#*$%&|<>"
_POWERS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(1, REPEAT_WINDOW + 1)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows that are found twice or more, the first included.

    Words are numbered within the text, so equal windows have equal sums; unequal ones of equal 64-bit sums are
    told apart by comparing the numbers.
    """
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, np.uint64)
    for j in range(REPEAT_WINDOW):
        sums += mixed[j : j + n] * _POWERS[j]
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    view = np.lib.stride_tricks.sliding_window_view(ids, REPEAT_WINDOW)
    equal = (view[a] == view[b]).all(axis=1)
    found = np.zeros(n + 1, bool)
    found[a[equal]] = found[b[equal]] = True
    steps = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(found[:n])
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    raw = utf8(text)
    words = raw.split()
    word_chars = len(text or "") - sum((text or "").count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    marks = len(raw) - len(raw.translate(None, _MARKS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return len(words), word_chars, symbols, dup, repeated_words(words), lines, marks, upper


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long"


def counted(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the counts of each whole text."""

    def make():
        def fn(batch):
            rows = [measure(x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            return list(zip(*rows, strict=True))

        return fn

    return append(docs, COUNTS, make, drop=() if keep_text else (text_col,))


def shares(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    words, chars = F.greatest(of("n_words"), F.lit(1)), F.greatest(of("word_chars"), F.lit(1))
    return {
        "symbol_share": of("n_symbols") / words,
        "word_length": of("word_chars") / words,
        "mark_share": of("n_marks") / chars,
        "upper_share": of("n_upper") / chars,
        "dup_line_share": of("n_dup_lines") / F.greatest(of("n_lines"), F.lit(1)),
    }


def thresholds(counts: DataFrame, lang_col: str = "lang", source_col: str = "source", k: int = SKETCH_K, min_group: int = MIN_GROUP) -> DataFrame:
    """A row per language and source: the fence of each measure, from the narrowest group of min_group rows or more.

    Rows that fail the base rules don't shape the sketches.
    """
    judged = counts.where(~base_failed()).select(F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"), *(x.alias(m) for m, x in shares().items()))
    pairs = counts.select(F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source")).distinct()
    narrow = cut(judged.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in MEASURES)))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in MEASURES)]
    by_lang = narrow.groupBy("g_lang").agg(*merged)
    overall = narrow.groupBy(F.lit(1).alias("one")).agg(*merged)

    def named(df: DataFrame, to: str, keys: list[str]) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{to}_{c}") for c in keys), F.col("n").alias(f"{to}_n"), *(F.col(m).alias(f"{to}_{m}") for m in MEASURES))

    s, w, a = named(narrow, "s", ["g_lang", "g_source"]), named(by_lang, "w", ["g_lang"]), named(overall, "a", ["one"])
    joined = (
        pairs.withColumn("one", F.lit(1))
        .join(s, F.col("g_lang").eqNullSafe(F.col("s_g_lang")) & F.col("g_source").eqNullSafe(F.col("s_g_source")), "left")
        .join(w, F.col("g_lang").eqNullSafe(F.col("w_g_lang")), "left")
        .join(a, F.col("one") == F.col("a_one"), "left")
    )

    def fence(m: str, spread: float) -> Column:
        sketch = F.when(F.col("s_n") >= min_group, F.col(f"s_{m}")).when(F.col("w_n") >= min_group, F.col(f"w_{m}")).otherwise(F.col(f"a_{m}"))
        low, high = F.kll_sketch_get_quantile_double(sketch, F.lit(0.25)), F.kll_sketch_get_quantile_double(sketch, F.lit(0.75))
        return (high + FENCE * F.greatest(high - low, F.lit(spread))).alias(f"max_{m}")

    return joined.select("g_lang", "g_source", *(fence(m, x) for m, x in MEASURES.items()))


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > REPEAT_PERCENT * of("n_words"))


def judge(counts: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """counts with base_failed, failed_rules and kept."""
    own = [c for c in counts.columns if c not in ("base_failed", "failed_rules", "kept")]
    # All columns of a row travel as one, so none of them can clash with those of the limits.
    rows = counts.select(F.struct(*(F.col(c) for c in own)).alias("row"))
    of = F.col("row").getField
    joined = rows.join(limits, of(lang_col).eqNullSafe(F.col("g_lang")) & of(source_col).eqNullSafe(F.col("g_source")), "left")
    failed = F.array_compact(F.array(*(F.when(x > F.col(f"max_{m}"), F.lit(m)) for m, x in shares(of).items())))
    return joined.select(*(of(c).alias(c) for c in own), base_failed(of).alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs with their counts, failed rules and verdict. Texts are counted once; the counted rows are kept in the shared
    folder, as thresholds and verdicts read them."""
    counts = written(counted(docs, text_col, keep_text))
    limits = small_side(cut(thresholds(counts, lang_col, source_col)), MAX_BROADCAST_GROUPS)
    return judge(counts, limits, lang_col, source_col)
