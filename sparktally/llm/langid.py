"""Language of words and documents by a linear-chain conditional random field.

A word's features are its character n-grams with its ends marked (so affixes are among them) and a lexicon: the words
that the training sample has mostly in one language. Transitions between the languages of neighbouring words are
learned, on sequences of which half change language midway. Forward-backward gives each word's distribution over the
languages; a document's language has the largest share of its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table

LETTERS = re.compile(r"[^\W\d_]+")
GRAMS, SLOTS, PIECE = (1, 2, 3, 4), 1 << 16, 32
UNKNOWN = "und"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one word after the other, and where each word's begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    slots, owners = [], []
    for n in GRAMS:
        at = np.nonzero(left >= n)[0]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ codes[at + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        slots.append((h >> np.uint64(48)).astype(np.int64) % SLOTS)
        owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    """Weights of the n-grams, the lexicon (word -> language) with its weights, transitions and starts."""

    langs: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    known: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        slots, begin = word_features(words)
        n = np.diff(np.append(begin, len(slots)))
        out = np.add.reduceat(self.grams[slots], begin, axis=0) / np.sqrt(n)[:, None]
        lex = np.array([self.lexicon.get(w, -1) for w in words])
        out[lex >= 0] += self.known[lex[lex >= 0]]
        return out


def soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def forward_backward(e: np.ndarray, size: np.ndarray, step: np.ndarray, start: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and, if they are to be counted, expected transition counts, which only training needs.

    e: (time, row, language) positive emissions; rows ordered by falling size, so that the rows still running at any
    time are the first ones. step, start: positive. Marginals beyond a row's size are zero.
    """
    t_max, running = len(e), [int((size > t).sum()) for t in range(len(e))]
    a, moves = np.zeros_like(e), np.zeros_like(step)
    if not t_max:
        return a, moves
    a[0] = unit(e[0] * start)
    for t in range(1, t_max):
        n = running[t]
        a[t, :n] = unit((a[t - 1, :n] @ step) * e[t, :n])
    b = np.ones_like(e[0])
    for t in range(t_max - 1, -1, -1):
        if t + 1 < t_max:
            n = running[t + 1]
            ahead = b[:n] * e[t + 1, :n]
            if count:
                total = np.einsum("ri,ij,rj->r", a[t, :n], step, ahead)
                moves += step * ((a[t, :n] / total[:, None]).T @ ahead)
            b[:n] = unit(ahead @ step.T)
        n = running[t]
        a[t, :n] = unit(a[t, :n] * b[:n])  # no earlier time needs the forward numbers of this one
    return a, moves


def pieces(text: str, most: int = 4) -> Iterator[list[str]]:
    """Up to ``most`` evenly spread runs of PIECE words."""
    words = LETTERS.findall(text.lower())
    for k in range(min(most, -(-len(words) // PIECE))):
        at = k * max(0, len(words) - PIECE) // max(1, min(most, -(-len(words) // PIECE)) - 1)
        yield words[at : at + PIECE]


def fit(rows: list[tuple[str, list[str]]], rounds: int = 80, rate: float = 0.25, decay: float = 1e-5, seed: int = 3) -> Model:
    """From (language, words) pieces, each of at most PIECE words, to a model; Adam on the exact log-likelihood."""
    langs, rng = sorted({x for x, _ in rows}), np.random.default_rng(seed)
    number, k = {x: i for i, x in enumerate(langs)}, len({x for x, _ in rows})
    count: dict[str, Counter] = defaultdict(Counter)
    for lang, words in rows:
        for w in words:
            count[w][number[lang]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in count.items() if c.total() >= 4 and c.most_common(1)[0][1] >= 0.8 * c.total()}
    vocab = sorted(count)
    place = {w: i for i, w in enumerate(vocab)}
    lines = [(np.array([place[w] for w in words]), np.full(len(words), number[lang])) for lang, words in rows if words]
    other = rng.permutation(len(lines))
    for i in range(0, len(lines), 2):
        (x, y), (u, v), half = lines[i], lines[other[i]], PIECE // 2
        lines[i] = np.append(x[:half], u[-half:]), np.append(y[:half], v[-half:])
    lines.sort(key=lambda x: -len(x[0]))
    size = np.array([len(x) for x, _ in lines])
    ids, truth = np.zeros((PIECE, len(lines)), np.int64), np.zeros((PIECE, len(lines), k))
    for r, (x, y) in enumerate(lines):
        ids[: len(x), r] = x
        truth[np.arange(len(y)), r, y] = 1
    inside = np.arange(PIECE)[:, None] < size
    moves = sum((truth[t].T @ truth[t + 1] for t in range(PIECE - 1)), np.zeros((k, k)))
    slots, begin = word_features(vocab)
    n_of = np.diff(np.append(begin, len(slots)))
    owner = np.repeat(np.arange(len(vocab)), n_of)
    by_slot = np.argsort(slots, kind="stable")
    used, first = np.unique(slots[by_slot], return_index=True)
    lex = np.array([lexicon.get(w, -1) for w in vocab])
    p = {"grams": np.zeros((SLOTS, k)), "known": np.zeros((k, k)), "step": np.zeros((k, k)), "start": np.zeros(k)}
    m1, m2 = {x: np.zeros_like(v) for x, v in p.items()}, {x: np.zeros_like(v) for x, v in p.items()}
    for i in range(1, rounds + 1):
        scores = np.add.reduceat(p["grams"][slots], begin, axis=0) / np.sqrt(n_of)[:, None]
        scores[lex >= 0] += p["known"][lex[lex >= 0]]
        g, seen = forward_backward(soft(scores)[ids], size, np.exp(p["step"]), np.exp(p["start"]))
        wrong = ((g - truth) * inside[:, :, None]).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.ravel(), wrong[:, j], len(vocab)) for j in range(k)], 1)
        d = {x: np.zeros_like(v) for x, v in p.items()}
        d["grams"][used] = np.add.reduceat((by_word / np.sqrt(n_of)[:, None])[owner[by_slot]], first, axis=0)
        for j in range(k):
            d["known"][j] = by_word[lex == j].sum(axis=0)
        d["step"], d["start"] = seen - moves, (g[0] - truth[0]).sum(axis=0)
        for x in p:
            grad = d[x] / len(lines) + decay * p[x]
            m1[x], m2[x] = 0.9 * m1[x] + 0.1 * grad, 0.99 * m2[x] + 0.01 * grad**2
            p[x] -= rate * (1 - i / (rounds + 1)) * (m1[x] / (1 - 0.9**i)) / (np.sqrt(m2[x] / (1 - 0.99**i)) + 1e-8)
    return Model(langs, p["grams"], lexicon, p["known"], np.exp(p["step"]), np.exp(p["start"]))


def train(docs: DataFrame, docs_by_lang: int = 400, pieces_by_doc: int = 4, most_langs: int = 200) -> Model | None:
    """Fits a model on a bounded sample: about ``docs_by_lang`` labelled documents of each language, chosen by a hash.

    Rows whose crc32 of the id is 2 modulo 4 are held out. None if no labelled row has letters. The ``most_langs``
    languages with most rows are learned, so that a column of other things than languages doesn't fill the driver.
    """
    rows = docs.where("lang is not null and text is not null").where(crc_of_id() % 4 != 2).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, docs_by_lang / n)])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(lang, i, " ".join(p)) for lang, i, text in zip(pdf["lang"], pdf["doc_id"], pdf["text"], strict=True) for p in pieces(text, pieces_by_doc)], columns=["lang", "doc_id", "words"])

    chosen = rows.where(place < share[F.col("lang")]).select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    found = sorted((r.doc_id, r.lang, r.words) for r in chosen.mapInPandas(cut, "lang string, doc_id string, words string").collect())
    return fit([(lang, words.split()) for _, lang, words in found]) if found else None


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Labeller:
    """Applies a model to texts, keeping the emissions of the words it has seen, up to a bound.

    numbers: about how many words times languages are worked on at a time; ahead: about how many words are read before,
    so that texts of like lengths go together. The more of either, the fewer steps along the texts.
    """

    def __init__(self, model: Model, most_words: int = 200_000, numbers: int = 1_000_000, at_once: int = 8_000, ahead: int = 4_000_000) -> None:
        self.model, self.most, self.cells, self.at_once, self.ahead = model, most_words, max(1, numbers // len(model.langs)), at_once, ahead
        self.place = Numbers()
        self.emit = np.zeros((0, len(model.langs)))

    def ids(self, text: str | None) -> np.ndarray:
        words = LETTERS.findall((text or "").lower())
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        """Works out the emissions of the words numbered since."""
        new = list(islice(self.place, len(self.emit), None))
        parts = [soft(self.model.scores(new[i : i + self.at_once])) for i in range(0, len(new), self.at_once)]
        self.emit = np.concatenate([self.emit, *parts])

    def marginals(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the text, its words' distributions) for each text that has letters."""
        k = 0
        while k < len(texts):  # as many texts at a time as bound the memory
            if len(self.place) > self.most:
                self.place, self.emit = Numbers(), self.emit[:0]
            ids, n = [], 0
            while k + len(ids) < len(texts) and n < self.ahead and len(self.place) - len(self.emit) <= self.most:
                ids.append(self.ids(texts[k + len(ids)]))
                n += len(ids[-1])
            self.learn()
            rows = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
            while rows:
                many = max(1, self.cells // len(ids[rows[0]]))
                now, rows = rows[:many], rows[many:]
                size = np.array([len(ids[i]) for i in now])
                table = np.zeros((size[0], len(now)), np.int32)
                for r, i in enumerate(now):
                    table[: size[r], r] = ids[i]
                g, _ = forward_backward(self.emit[table], size, self.model.step, self.model.start, count=False)
                for r, i in enumerate(now):
                    yield k + i, g[: size[r], r]
            k += len(ids)


def verdicts(labeller: Labeller | None, texts: list[str | None]) -> pd.DataFrame:
    """(lang_pred, score, n_words, n_switches) of each text, as in predict()."""
    n = len(texts)
    lang, score, words, turns = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, g in labeller.marginals(texts) if labeller else ():
        mean, best = g.mean(axis=0), g.argmax(axis=1)
        lang[i], score[i], words[i], turns[i] = labeller.model.langs[mean.argmax()], min(1.0, mean.max()), len(g), int((best[1:] != best[:-1]).sum())
    return pd.DataFrame({"lang_pred": lang, "score": score, "n_words": words, "n_switches": turns})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) for each row.

    score: the language's expected share of the words. A text that is null or has no letters: ``und``, 0. Ties go to
    the language first by code point. Without a model every text is ``und``. Texts of any length are read whole, one at
    a time if need be. Repeated rows each get their row. Other columns, whatever their names, are ignored. No rows: none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model) if model else None
        for pdf in batches:
            out = verdicts(labeller, pdf["text"].tolist())
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, lang_pred string, score double, n_words long, n_switches long").withColumn("doc_id", F.col("doc_id").cast("long"))


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word_no, word, lang, probability) for each word of letters: the labels of code-switched text.

    Texts that are null or have no letters give no rows. Rows with a null id give theirs with a null doc_id, repeated rows
    each give theirs. Texts of any length are read whole. Other columns, whatever their names, are ignored. No rows: none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for i, g in labeller.marginals(texts):
                words = LETTERS.findall(texts[i].lower())
                yield pd.DataFrame({"doc_id": [ids[i]] * len(g), "word_no": np.arange(len(g)), "word": words, "lang": [model.langs[j] for j in g.argmax(axis=1)], "probability": g.max(axis=1)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, word_no long, word string, lang string, probability double").withColumn("doc_id", F.col("doc_id").cast("long"))


def read_whole(docs: DataFrame) -> DataFrame:
    """(row, found) of each text with letters: the row of ``docs`` in a struct, and what the model trained on them found.

    The model reads every text, whether its lang is given or not. Without a labelled row there is none: letters, as op1
    sees them, decide alone, and what is found is null.
    """
    model = train(docs)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.tolist()
            found = verdicts(labeller, texts)
            known = found["n_words"] > 0 if model else pd.Series([LETTERS.search((t or "").lower()) is not None for t in texts], dtype=bool)
            yield pd.DataFrame({"known": known, "lang_pred": found["lang_pred"] if model else None, "lang_score": found["score"].round(6) if model else None})

    # were it deterministic, Spark would run it once for the filter and once more for its columns
    read = F.pandas_udf(run, "known boolean, lang_pred string, lang_score double").asNondeterministic()
    return docs.select(F.struct(*docs.columns).alias("row"), read("text").alias("found")).where("found.known")


def with_language(columns: list[str]) -> list[Column]:
    """These columns of read_whole()'s rows, a missing lang filled in."""
    return [F.coalesce(F.col("row")[c], F.col("found.lang_pred")).alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in columns]


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that are null or have no letters (op1's ``und``); the others' missing languages are filled in.

    The model, trained on the labelled rows, reads every text; where lang is null it writes what it finds into that column.
    Languages that are given stay as they are, mixed texts too; identified() also says what the model finds for those.
    Where no row is labelled, missing languages stay null. No rows: none.
    """
    return read_whole(docs).select(*with_language(docs.columns))


def identified(docs: DataFrame) -> DataFrame:
    """keep_known() with lang_pred and lang_score of every row: the language the model finds and its expected share of the words.

    A given language can so be held against the text. Null without a labelled row. Columns named like these two give way.
    """
    others = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    return read_whole(docs).select(*with_language(others), "found.lang_pred", "found.lang_score")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (crc_of_id() % 4 == 2).alias("held_out")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out, "lang_pred", "score", "n_words", "n_switches")
