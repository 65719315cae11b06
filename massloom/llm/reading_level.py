"""Reading level of English prose by smoothed unigram language models per grade.

Two families of unigram models are fitted for the grades 1 to 5: one over the words, one over the lengths of the sentences, since a text can
have plain words in long sentences. Which grade of words and of sentences a labelled text has isn't labelled; expectation-maximization
finds both, seeded by the formula that a text's level is about the mean of the two. The level is the one with the highest posterior
likelihood. What is English prose is decided by smoothed unigram models too, of prose and of other texts, fitted on all labelled texts and all
others; every text is then judged as a whole. A round of expectation-maximization is a pass over the texts' bags of words, whose sums are added
up in pieces; the driver holds the models only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import materialize

GRADES = 5
#: Numbers of one piece of the sums that tasks hand on.
PIECE = 1 << 16
#: Words that a text has to have.
LEAST_WORDS = 40
#: Rounds of expectation-maximization; counts are smoothed by adding this to each, shares of the prose models by adding that.
ROUNDS = 25
SMOOTHING = 0.05
PROSE_SMOOTHING = 1e-4
#: A text begins as prose if its share of words known from labelled texts is at least this part of what such texts know of each other.
FIRST_SHARE = 0.85
_MARKUP = regex.compile(r"<[^<>]{0,200}>|&[a-z]{2,8};|https?://\S+")
_WORD = regex.compile(r"\p{L}+(?:[-'’]\p{L}+)*")
_ENDS = regex.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|\n\s*\n")


def tokens(text: str | None) -> tuple[list[str], list[int]]:
    """The lower-case words of a text and the numbers of words of its sentences; none for null."""
    if not text:
        return [], []
    plain = _MARKUP.sub(" ", text)
    words = _WORD.findall(plain.lower())
    lengths = [n for s in _ENDS.split(plain) if (n := len(_WORD.findall(s)))]
    return words, lengths


def _length_class(n: int) -> int:
    return min(int(4 * math.log2(n)), 31)


class Bags:
    """Counts of texts by row and column, only those above 0: (row, column, count) with the rows in order."""

    def __init__(self, counts: list[Counter], place, width: int) -> None:
        self.n, self.width = len(counts), width
        self.row = np.repeat(np.arange(self.n), [len(c) for c in counts])
        self.column = np.fromiter((place(x) for c in counts for x in c), np.int64, len(self.row))
        self.count = np.fromiter((n for c in counts for n in c.values()), np.float64, len(self.row))
        self.sizes = np.bincount(self.row, self.count, self.n)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Of each text the sum of its columns' values."""
        return np.stack([np.bincount(self.row, self.count * v[self.column], self.n) for v in values.T], axis=1)

    def by_column(self, weights: np.ndarray) -> np.ndarray:
        """Of each column the sum of its counts, by the texts' weights."""
        return np.stack([np.bincount(self.column, self.count * w[self.row], self.width) for w in weights.T], axis=1)


@dataclass
class Model:
    """Log probabilities by word (the last row is any other word): prose over other texts, and grades; sentences (class x grade), and level given both."""

    index: dict[str, int]
    prose: np.ndarray
    prior: float
    words: np.ndarray
    sentences: np.ndarray
    joint: np.ndarray

    def level(self, words: Counter, lengths: Counter) -> int:
        """The level with the highest posterior; 0 if the text is too short or likelier no English prose."""
        n = np.fromiter(words.values(), np.float64, len(words))
        if n.sum() < LEAST_WORDS:
            return 0
        other = len(self.index)
        rows = np.fromiter((self.index.get(x, other) for x in words), np.int64, len(words))
        if n @ self.prose[rows] + self.prior <= 0:
            return 0
        by_words = n @ self.words[rows]
        by_sentences = np.fromiter(lengths.values(), np.float64, len(lengths)) @ self.sentences[np.fromiter(lengths, np.int64, len(lengths))]
        posterior = self.joint + (by_words[:, None] + by_sentences[None, :])[:, :, None]
        return 1 + int(np.exp(posterior - posterior.max()).sum(axis=(0, 1)).argmax())


def counted(words: list[str], lengths: list[int]) -> tuple[Counter, Counter]:
    return Counter(words), Counter(map(_length_class, lengths))


@dataclass
class Texts:
    """Some texts' bags of words (columns of the index, the last is any other word) and sentences, readers by grade, and shares of words that labelled texts know."""

    words: Bags
    sentences: Bags
    grades: np.ndarray
    known: np.ndarray

    @property
    def labelled(self) -> np.ndarray:
        return self.grades.any(axis=1)


#: What sums a step over all texts: (step, state) to (sums, the greatest of the steps' second results).
Summed = Callable[[Callable[[Texts, tuple], tuple[np.ndarray, float]], tuple], tuple[np.ndarray, float]]


def known_share(words: Bags, labelled: np.ndarray, in_labelled: np.ndarray) -> np.ndarray:
    """Of each text the share of words that other labelled texts have too; `in_labelled` has each column's number of labelled texts, 0 for the last."""
    known = in_labelled[words.column] > labelled[words.row]
    return np.bincount(words.row, words.count * known, words.n) / np.maximum(words.sizes, 1)


def _prose(t: Texts, least: float, model: tuple[np.ndarray, float] | None) -> np.ndarray:
    """How far each text is prose: by a model, without one by its share of known words."""
    after = t.known >= least if model is None else 1 / (1 + np.exp(-np.clip(t.words.by_text(model[0][:, None])[:, 0] + model[1], -50, 50)))
    return np.where(t.labelled, 1.0, after)


def _prose_step(t: Texts, state: tuple) -> tuple[np.ndarray, float]:
    """By column the sums of prose and of all texts, each text of the same weight; the prose of the texts without label and their number; how far any moved."""
    least, before, model = state
    prose, other = _prose(t, least, model), ~t.labelled
    moved = np.inf if model is None else np.abs(prose - _prose(t, least, before)).max(initial=0.0)
    sums = t.words.by_column(np.stack([prose, 1 - prose], axis=1) / np.maximum(t.words.sizes, 1)[:, None])
    return np.concatenate([sums.T.ravel(), [prose[other].sum(), other.sum()]]), float(moved)


def prose_model(summed: Summed, least: float) -> tuple[np.ndarray, float]:
    """(log odds of prose by word, log odds before any word) from smoothed unigram models of prose and of other texts.

    Labelled texts are prose. Which of the others are is found by expectation-maximization, begun by their share of words that labelled texts know.
    """
    before = model = None
    for _ in range(ROUNDS):
        sums, moved = summed(_prose_step, (least, before, model))
        if moved < 1e-3:
            break
        shares = sums[:-2].reshape(2, -1).T + PROSE_SMOOTHING
        logs = np.log(shares / shares.sum(axis=0))
        part = np.clip(sums[-2] / sums[-1] if sums[-1] else 0.5, 0.01, 0.99)
        before, model = model, (logs[:, 0] - logs[:, 1], float(np.log(part / (1 - part))))
    return model


def _grade_step(t: Texts, state: tuple) -> tuple[np.ndarray, float]:
    """The expected counts of words and sentences by grade and of the grades by level, of the labelled texts."""
    graded, words, lengths, joint = state
    bags = Bags.__new__(Bags)
    bags.n, bags.width, bags.row, bags.column, bags.count = t.words.n, len(words), t.words.row, graded[t.words.column], t.words.count
    text, label = np.nonzero(t.grades)
    posterior = joint[:, :, label].transpose(2, 0, 1) + bags.by_text(words)[text][:, :, None] + t.sentences.by_text(lengths)[text][:, None, :]
    posterior = np.exp(posterior - posterior.max(axis=(1, 2), keepdims=True))
    posterior *= (t.grades[text, label] / posterior.sum(axis=(1, 2)))[:, None, None]
    of_text = np.zeros((bags.n, GRADES, GRADES))
    np.add.at(of_text, text, posterior)
    both = np.stack([posterior[label == k].sum(axis=0) for k in range(GRADES)], axis=2)
    return np.concatenate([bags.by_column(of_text.sum(2)).ravel(), t.sentences.by_column(of_text.sum(1)).ravel(), both.ravel()]), 0.0


def fitted(summed: Summed, summed_labelled: Summed, index: dict[str, int], in_labelled: np.ndarray, least: float) -> Model:
    """The models from sums over all texts and over the labelled ones."""
    odds, prior = prose_model(summed, least)
    # The grades are told apart by the words of two labelled texts or more; all others are one.
    told = in_labelled > 1
    graded = np.where(told, np.cumsum(told) - 1, told.sum())
    grade = np.arange(1, GRADES + 1)
    mean = (grade[:, None] + grade[None, :]) / 2
    # The formula: a level is near the mean of the two grades, which are mostly equal.
    seed = np.exp(-2 * (grade - mean[:, :, None]) ** 2 - 0.5 * np.abs(grade[:, None] - grade[None, :])[:, :, None])
    seed /= seed.sum()
    words, lengths, joint = np.zeros((told.sum() + 1, GRADES)), np.zeros((32, GRADES)), np.log(seed)
    for _ in range(ROUNDS):
        sums, _ = summed_labelled(_grade_step, (graded, words, lengths, joint))
        of_words, of_lengths, both = np.split(sums, [words.size, words.size + lengths.size])
        words, lengths = _log_shares(of_words.reshape(words.shape)), _log_shares(of_lengths.reshape(lengths.shape))
        both = both.reshape(joint.shape) + GRADES * seed
        joint = np.log(both / both.sum())
    return Model(index, odds, prior, words[graded], lengths, joint)


def vocabulary(counts: Iterable[tuple[str, int, int]]) -> tuple[dict[str, int], np.ndarray]:
    """(index, by column the number of labelled texts) of the words of three texts or of two labelled ones, from (word, texts, labelled texts)."""
    kept = sorted((w, g) for w, n, g in counts if n > 2 or g > 1)
    return {w: i for i, (w, _) in enumerate(kept)}, np.array([*(g for _, g in kept), 0], np.int64)


def fit(labelled: list[tuple[Counter, Counter]], grades: list[list[int]], others: list[Counter]) -> Model | None:
    """Models from labelled texts in memory, each with how many readers gave it each grade, and from other texts; None without labelled ones."""
    if not labelled:
        return None
    of_graded = Counter(w for c, _ in labelled for w in c)
    seen = of_graded + Counter(w for c in others for w in c)
    index, in_labelled = vocabulary((w, n, of_graded[w]) for w, n in seen.items())
    words = Bags([*(c for c, _ in labelled), *others], lambda x: index.get(x, len(index)), len(index) + 1)
    mine = np.arange(words.n) < len(labelled)
    share = known_share(words, mine, in_labelled)
    readers = np.concatenate([np.array(grades, np.int64).reshape(-1, GRADES), np.zeros((len(others), GRADES), np.int64)])
    texts = Texts(words, Bags([*(s for _, s in labelled), *[Counter()] * len(others)], lambda x: x, 32), readers, share)
    summed = lambda step, state: step(texts, state)
    return fitted(summed, summed, index, in_labelled, FIRST_SHARE * float(np.median(share[mine])))


def _log_shares(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTHING
    return np.log(smooth / smooth.sum(axis=0))


def _fit_table(bags: DataFrame) -> Model | None:
    """`fit` of all rows of a written table of bags, by sums over its parts."""
    spark = bags.sparkSession
    is_labelled = F.exists("grades", lambda n: n > 0)
    in_texts = bags.select(F.explode("words").alias("word"), is_labelled.cast("int").alias("labelled")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("g"))
    index, in_labelled = vocabulary(tuple(r) for r in in_texts.filter("n > 2 OR g > 1").toLocalIterator())
    known_words = spark.sparkContext.broadcast((index, in_labelled))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, in_labelled = known_words.value
        for b in batches:
            ids = [[index.get(w, len(index)) for w in ws] for ws in b["words"]]
            b = b.assign(ids=ids)
            b["known"] = known_share(_bags(b["ids"], b["word_counts"], len(index) + 1), np.array([np.any(g) for g in b["grades"]], bool), in_labelled)
            yield b[["grades", "ids", "word_counts", "lengths", "length_counts", "known"]]

    coded = materialize(bags.mapInPandas(encode, "grades array<bigint>, ids array<int>, word_counts array<bigint>, lengths array<int>, length_counts array<bigint>, known double"), "coded")
    labelled = coded.filter(is_labelled)
    middle = labelled.agg(F.expr("percentile(known, 0.5)")).first()[0]
    if middle is None:
        return None
    width = len(index) + 1

    def over(rows: DataFrame) -> Summed:
        return lambda step, state: _summed(rows, width, step, state)

    return fitted(over(coded), over(materialize(labelled, "labelled")), index, in_labelled, FIRST_SHARE * middle)


def _bags(values: Iterable, counts: Iterable, width: int) -> Bags:
    """Bags of lists of columns and of their counts."""
    bags = Bags.__new__(Bags)
    values, counts = [np.asarray(v, np.int64) for v in values], [np.asarray(c, np.float64) for c in counts]
    bags.n, bags.width = len(values), width
    bags.row = np.repeat(np.arange(bags.n), [len(v) for v in values])
    bags.column, bags.count = np.concatenate([np.zeros(0, np.int64), *values]), np.concatenate([np.zeros(0), *counts])
    bags.sizes = np.bincount(bags.row, bags.count, bags.n)
    return bags


def _summed(coded: DataFrame, width: int, step: Callable[[Texts, tuple], tuple[np.ndarray, float]], state: tuple) -> tuple[np.ndarray, float]:
    """A step's sums over all rows: each task adds up its own, and pieces of them are added up by place."""
    sent = coded.sparkSession.sparkContext.broadcast(state)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, most = None, -np.inf
        for b in batches:
            if len(b):
                t = Texts(_bags(b["ids"], b["word_counts"], width), _bags(b["lengths"], b["length_counts"], 32), np.stack(b["grades"]).astype(np.int64), b["known"].to_numpy(float))
                sums, moved = step(t, sent.value)
                total, most = sums if total is None else total + sums, max(most, moved)
        if total is not None:
            yield pd.DataFrame({"place": range(0, len(total), PIECE), "sums": [total[k : k + PIECE].tobytes() for k in range(0, len(total), PIECE)], "most": most})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": b["place"].iloc[:1], "sums": [np.sum([np.frombuffer(x) for x in sorted(b["sums"])], axis=0).tobytes()], "most": [b["most"].max()]})

    shape = "place bigint, sums binary, most double"
    rows = sorted(coded.mapInPandas(partial, shape).groupBy("place").applyInPandas(add, shape).collect())
    sent.unpersist()
    return np.concatenate([np.frombuffer(r["sums"]) for r in rows]), max(r["most"] for r in rows)


def reading_levels(texts: DataFrame, labels: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """(`key`, reading_level) of every row whose text is English prose of at least LEAST_WORDS words.

    `labels` has (`key`, `level`); null levels and those outside 1 to 5 are left out, and of several levels of a text each counts. Null,
    empty and blank texts, listings and other languages give no rows; without labels no text has a level. Only the named columns are
    read; repeated rows come out as often as they occur.
    """
    graded = labels.filter(F.col(level).between(1, GRADES)).select(F.col(key).alias("key"), F.col(level).cast("int").alias("level"))
    grades = F.array(*[F.count(F.when(F.col("level") == k, 1)) for k in range(1, GRADES + 1)])
    bare = texts.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    one = bare.groupBy("key").agg(F.min("text").alias("text")).join(graded.groupBy("key").agg(grades.alias("grades")), "key", "left")
    one = one.select("text", F.coalesce("grades", F.array([F.lit(0).cast("bigint")] * GRADES)).alias("grades"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, g in zip(b["text"], b["grades"], strict=True):
                w, n = counted(*tokens(t))
                if sum(w.values()) >= LEAST_WORDS:
                    rows.append((list(g), list(w), list(w.values()), list(n), list(n.values())))
            yield pd.DataFrame(rows, columns=["grades", "words", "word_counts", "lengths", "length_counts"])

    shape = "grades array<bigint>, words array<string>, word_counts array<bigint>, lengths array<int>, length_counts array<bigint>"
    model = _fit_table(materialize(one.mapInPandas(count, shape), "bags"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            levels = np.fromiter((0 if model is None else model.level(*counted(*tokens(t))) for t in b[text]), np.int32, len(b))
            b = b.assign(reading_level=levels)[["key", "reading_level"]]
            yield b[b["reading_level"] > 0]

    kind = texts.schema[key].dataType.simpleString()
    out = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), text).mapInPandas(assign, f"key {kind}, reading_level int")
    return out.withColumnRenamed("key", key)
