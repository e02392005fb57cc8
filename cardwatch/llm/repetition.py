"""Quality rules on repetition: suffix arrays of words, LCP values, spans of maximal repeats.

A batch of documents gets one suffix array by prefix doubling; a suffix's key starts with its document, so suffixes of different
documents never meet, and suffixes that are already unique leave the sorting. The ranks of every doubling give the longest common
prefix of neighbours in the array by binary lifting. The deepest LCP interval around suffix i has depth L(i), the larger LCP to its
two neighbours: the longest string at i that occurs elsewhere in the document. Every maximal repeat's occurrence lies in
[i, i + L(i)) for its start i, and each of those lies in an occurrence of a maximal repeat, so the union of these spans is the
union of all maximal repeats of at least the least length.

A document fails if the spans cover more than ``max_covered`` of its words or its longest repeat exceeds ``max_longest`` of its
words and ``long_repeat`` words. Documents are handled whole and apart: no shuffle, memory bounded by the largest document.

Edges: null, empty and blank texts have no words and fail the least count; one word has no repeats; null and repeated ids are kept
as they are; an empty table gives no rows; only the key and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import table, words

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: words sorted together
BATCH_WORDS = 300_000
MIN_REPEAT, MAX_COVERED, LONG_REPEAT, MAX_LONGEST = 10, 0.4, 50, 0.2
RESULT = (
    "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered long, longest_repeat long, spans array<struct<start:long,stop:long>>"
)


def suffix_ranks(codes, ends):
    """Suffix array of concatenated documents and the ranks after each doubling.

    ``codes`` are word codes that differ between documents, ``ends[i]`` is the end of the document of position i.
    """
    import numpy as np

    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.r_[True, codes[order][1:] != codes[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    array, levels, step = order, [rank.copy()], 1
    shared = ~fresh | np.r_[~fresh[1:], False] if n else fresh
    slots = np.flatnonzero(shared)
    while len(slots):
        active = array[slots]
        beyond = active + step
        inside = beyond < ends[active]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        first = rank[active]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        active, first, second = active[by], first[by], second[by]
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[active] = np.maximum.accumulate(np.where(fresh, slots, 0))
        array[slots] = active
        levels.append(rank.copy())
        slots = slots[~fresh | np.r_[~fresh[1:], False]]
        step *= 2
    return array, levels


def longest_repeats(codes, ends):
    """For every position, the length of the longest word string there that occurs elsewhere in its document."""
    import numpy as np

    n = len(codes)
    longest = np.zeros(n, np.int64)
    array, levels = suffix_ranks(codes, ends)
    left, right = array[:-1], array[1:]
    near = levels[0][left] == levels[0][right]
    left, right = left[near], right[near]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        rank = levels[level]
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        common += np.where(same, 1 << level, 0)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered(lengths, size: int | None = None):
    """Positions inside [i, i + lengths[i]) for some i; lengths are 0 or, with ``size``, cut to it where they reach it."""
    import numpy as np

    n = len(lengths)
    reach = np.where(lengths >= size, size, 0) if size else lengths
    stop = np.maximum.accumulate(np.where(reach > 0, np.arange(n) + reach, 0))
    return stop > np.arange(n)


def line_repeats(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def scanner(min_repeat: int):
    """mapInPandas function: (doc_id, text) to ``RESULT``."""

    def scan(batches):
        import numpy as np
        import pandas as pd

        names = [c.split()[0] for c in RESULT.split(", ")]

        def finish(part):
            sizes = np.array([len(w) for _, _, w in part])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.fromiter((hash(w) for _, _, ws in part for w in ws), np.int64, int(starts[-1]))
            document = np.repeat(np.arange(len(part)), sizes)
            _, code = np.unique(flat, return_inverse=True)
            lengths = longest_repeats(document * (len(flat) + 1) + code, starts[1:][document])
            windows = covered(lengths, 3)
            long_ones = np.where(lengths >= min_repeat, lengths, 0)
            inside = covered(long_ones)
            rows = []
            for k, (doc, text, _) in enumerate(part):
                a, b = starts[k], starts[k + 1]
                edge = np.diff(np.r_[False, inside[a:b], False].astype(np.int8))
                spans = [
                    {"start": int(s), "stop": int(e)}
                    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                ]
                rows.append((
                    doc, b - a, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), line_repeats(text),
                    windows[a:b].sum(), inside[a:b].sum(), long_ones[a:b].max(initial=0), spans,
                ))
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            part, held = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"].fillna(""), strict=True):
                found = words(text)
                if part and held + len(found) > BATCH_WORDS:
                    yield finish(part)
                    part, held = [], 0
                part.append((doc, text, found))
                held += len(found)
            if part:
                yield finish(part)

    return scan


def repetition(docs: DataFrame, *, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
               long_repeat: int = LONG_REPEAT, max_longest: float = MAX_LONGEST, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Counts, merged word spans of maximal repeats, and the verdicts base_failed, repetitive and kept of every document."""
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(scanner(min_repeat), RESULT)
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    repetitive = (F.col("n_covered") > max_covered * n) | (
        (F.col("longest_repeat") > long_repeat) & (F.col("longest_repeat") > max_longest * n)
    )
    return (
        found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
        .withColumn("base_failed", base).withColumn("repetitive", repetitive)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("repetitive"))
    )


def op10_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat",
        "base_failed", "kept",
    )
