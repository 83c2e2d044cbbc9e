"""Benchmark decontamination: rare n-gram seeds propose passages, Smith-Waterman alignment scores them.

One pass over the documents counts in how many of them each n-gram of the benchmark occurs (partial counts in each task,
then a sum by n-gram) and keeps those with two n-grams of one item on near diagonals. Among these the rare n-grams
decide: those in few documents, or in no more than five times the item's mean, so that an item keeps its own however
often it was leaked. Two hits on near diagonals propose a window, which is aligned word by word; nothing is capped. The benchmark is read in blocks of a
bounded number of items, so what a task holds doesn't grow with it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

TOKEN = re.compile(r"\w+")
RESULT = "key string, item_id long, score double, matched int, item_words int, start long, end long"


class Seeds:
    """The n-grams of one block of items, as sorted integer codes of word numbers."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int) -> None:
        self.n, self.vocab = n, {}
        number = lambda w: self.vocab.setdefault(w, len(self.vocab))
        self.words = {i: np.array([number(w) for w in words], np.int64) for i, words in items if len(words) >= n}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, words in self.words.items():
            for k, code in enumerate(self.codes(words).tolist()):
                self.places[code].append((i, k))
        self.sorted = np.array(sorted(self.places), np.int64)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The code of the n-gram at each position; -1 where it has a word that no item has."""
        size, base = len(words) - self.n + 1, len(self.vocab) + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(self.n):
            part = words[k : k + size]
            out, known = out * base + part, known & (part >= 0)
        return np.where(known, out, -1)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The document's word numbers (-1: in no item), the positions of the seeds in it, and their codes."""
        get = self.vocab.get
        words = np.fromiter((get(w, -1) for w in TOKEN.findall(text.lower())), np.int64)
        codes = self.codes(words)
        if not len(self.sorted) or not len(codes):
            return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.nonzero(codes >= 0)[0]
        near = np.minimum(np.searchsorted(self.sorted, codes[at]), len(self.sorted) - 1)
        at = at[self.sorted[near] == codes[at]]
        return words, at, codes[at]

    def keep_rare(self, found_in: dict[int, int], rare: float) -> None:
        """Drops n-grams of common words: those in more than ``rare`` documents and five times the item's mean.

        The mean makes room for leaks: where copies of an item, whole or edited, are frequent, so are most of its n-grams.
        """
        keep: set[int] = set()
        for words in self.words.values():
            codes = np.unique(self.codes(words)).tolist()
            most = max(rare, 5 * sum(found_in.get(c, 0) for c in codes) / len(codes))
            keep.update(c for c in codes if found_in.get(c, 0) <= most)
        self.places = {c: p for c, p in self.places.items() if c in keep}
        self.sorted = np.array(sorted(self.places), np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words (match 1, mismatch -1, gap -1): the best score, matches, first and last+1 text word.

    One row of the table is kept. A cell packs its score, then the matches and the first word of the best way to it, so
    that the greater number is the better way; texts and items may have up to 2 ** 20 words.
    """
    score, match = 1 << 42, 1 << 21
    step = np.arange(len(text) + 1, dtype=np.int64)
    gaps, fresh = step * score, step.copy()
    row, best, end = fresh, 0, 0
    for w in item.tolist():
        now = np.maximum(fresh, row - score)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(text == w, score + match, -score))
        row = np.maximum.accumulate(now + gaps) - gaps
        at = int((row >> 42).argmax())
        if row[at] >> 42 > best >> 42:
            best, end = int(row[at]), at
    return best >> 42, best % score // match, best % match, end


def windows(hits: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that may hold an item, from its seeds (place in the text, place in the item)."""
    slack = length // 4 + 4
    starts = sorted((p - k, k) for p, k in hits)
    first = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i][0] - starts[i - 1][0] > slack:
            if i - first >= 2:
                yield starts[first][0] - slack, starts[i - 1][0] + length + slack
            first = i


def by_item(seeds: Seeds, at: np.ndarray, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """The seeds of each item, from (place in the text, code)."""
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, c in zip(at.tolist(), codes.tolist(), strict=True):
        for i, k in seeds.places[c]:
            by[i].append((p, k))
    return by


def matches(text: str, seeds: Seeds, least: float) -> Iterator[tuple]:
    """(item_id, score, matched, item_words, start, end) of each item whose best alignment reaches ``least``."""
    words, at, codes = seeds.hits(text)
    found = []
    for i, hits in by_item(seeds, at, codes).items():
        item, best = seeds.words[i], None
        for a, b in windows(hits, len(item)):
            a = max(0, a)
            # a long stretch (an item repeated again and again) is read in overlapping pieces
            for c in range(a, max(a + 1, b - len(item)), 8 * len(item) + 64):
                part = words[c : min(b, c + 10 * len(item) + 128)]
                score, same, s, e = align(item, part)
                if score >= least * len(item) and (best is None or score > best[1]):
                    best = i, score, same, len(item), c + s, c + e
        if best:
            found.append(best)
    if found:
        spans = [m.span() for m in TOKEN.finditer(text)] if len(text.lower()) == len(text) else None
        for i, score, same, n, s, e in found:
            yield i, score / n, same, n, spans[s][0] if spans else None, spans[e - 1][1] if spans else None


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, rare_share: float = 1e-4, block_items: int = 10_000, block_chars: int = 4_000_000) -> DataFrame:
    """One row (doc_id, item_id, score, ...) for each document and item of which it holds a whole or edited copy.

    score: alignment score over the item's words, 1 for an exact copy. start, end: characters of the best copy (null
    where lower-casing changes the text's length). Texts of any length are read whole; long items are aligned in memory
    that grows with the window alone. Null or empty texts match nothing; items of fewer than ``n`` words
    are not looked for; repeated rows and rows with a null id each give their rows; ties go to the first copy in the text. Empty tables: no
    rows. Other columns are ignored. Items with one text but several ids are all reported. A block holds about ``block_items``
    items and ``block_chars`` characters, so that n-grams of its words can be numbered in 64 bits.
    """
    out = _found(docs.select(F.col("doc_id").cast("string").alias("key"), "text"), benchmark, n, least, rare_share, block_items, block_chars)
    return out.withColumnsRenamed({"key": "doc_id"}).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _found(docs: DataFrame, benchmark: DataFrame, n: int, least: float, rare_share: float, block_items: int, block_chars: int) -> DataFrame:
    """The same by ``key``, a text of any kind that may repeat or be null, for rows (key, text)."""
    docs = docs.where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null and item_id is not null").distinct()
    # more rows than items (an id with two texts) only make a block slightly larger
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size["items"] / block_items), math.ceil(size["chars"] / block_chars))
    limit, out = rare_share * docs.count(), None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        seeds = Seeds([(r.item_id, TOKEN.findall(r.text.lower())) for r in sorted(own)], n)

        def count(batches: Iterator[pd.DataFrame], seeds: Seeds = seeds) -> Iterator[pd.DataFrame]:
            total: dict[int, int] = defaultdict(int)
            for pdf in batches:
                keep = np.zeros(len(pdf), bool)
                for r, text in enumerate(pdf["text"]):
                    _, at, codes = seeds.hits(text)
                    for c in np.unique(codes).tolist():
                        total[c] += 1
                    keep[r] = len(at) > 1 and any(True for i, hits in by_item(seeds, at, codes).items() for _ in windows(hits, len(seeds.words[i])))
                yield pdf[keep].assign(code=0, docs=0)
            yield pd.DataFrame({"key": None, "text": None, "code": list(total), "docs": list(total.values())})

        # rows with a text are documents to look at, the others are counts
        seen = written(docs.mapInPandas(count, "key string, text string, code long, docs long"), "seeds")
        in_docs = seen.where("text is null").groupBy("code").agg(F.sum("docs").alias("docs"))
        seeds.keep_rare({r.code: r.docs for r in in_docs.collect()}, limit)  # at most the block's own n-grams

        def find(batches: Iterator[pd.DataFrame], seeds: Seeds = seeds) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, *m) for d, text in zip(pdf["key"], pdf["text"], strict=True) for m in matches(text, seeds, least)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")]).astype({"start": "Int64", "end": "Int64"})

        found = seen.where("text is not null").select("key", "text").mapInPandas(find, RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a copy of a benchmark item.

    The text alone decides, whatever a row's id: rows without an id, with a shared one and repeated rows each by
    themselves. Null and empty texts stay. Columns may have any names. No rows: none.
    """
    text = F.md5(F.col("text"))
    found = _found(docs.select(text.alias("key"), "text"), benchmark, 3, 0.4, 1e-4, 10_000, 4_000_000).select(F.col("key").alias("contaminated_text")).distinct()
    return docs.join(found, text == F.col("contaminated_text"), "left_anti").select(docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
