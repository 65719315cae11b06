"""Token ids of a whole corpus by a public byte-level BPE.

The frequent words of the corpus are counted over all texts, encoded once on the driver and compiled into a transducer (see
`lexicon`). Tasks look up the distinct words of a batch in it all at once and merge the others exactly, by rank.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.lexicon import Lexicon, compile_lexicon
from massloom.session import send_file

#: Where the vocabulary files of the public tokenizers are.
TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's publisher cuts texts into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon, the most frequent ones: what the driver gets is bounded by it.
LEXICON_WORDS = 50_000
#: Longer words aren't counted; they are merged where they occur.
LEXICON_WORD_LENGTH = 64
#: Distinct words that a task counts before it hands on its sums, and characters of text that a task cuts into words at once.
WORDS_IN_MEMORY = 300_000
CHARS_AT_ONCE = 2_000_000
#: Merged words that a worker keeps.
CACHED_WORDS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the adjacent pair of least rank, leftmost first, is merged until none has a rank. Linear up to a logarithm."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
            continue
        merged = left + parts[j]
        parts[i], parts[j] = merged, None
        after[i] = k = after[j]
        if k < n:
            prior[k] = i
            if (r := ranks.get(merged + parts[k])) is not None:
                heapq.heappush(heap, (r, i, len(merged) + len(parts[k])))
        if (h := prior[i]) >= 0 and (r := ranks.get(parts[h] + merged)) is not None:
            heapq.heappush(heap, (r, h, len(parts[h]) + len(merged)))
    return [ranks[p] for p in parts if p is not None]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS_AT_ONCE characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def frequent_words(texts: DataFrame, text: str, most: int = LEXICON_WORDS) -> list[str]:
    """The `most` most frequent words of all texts, ties by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(WORD_PATTERN).findall
        counts: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            held = {w: n for w, n in counts.items() if len(w) <= LEXICON_WORD_LENGTH}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(find(t))
                    if len(counts) > WORDS_IN_MEMORY:
                        yield hand_on()
        yield hand_on()

    partial = texts.select(text).mapInArrow(count, "word string, n bigint")
    top = partial.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in top.collect()]


class Encoder:
    """Encodes lists of texts with a compiled lexicon and the ranks."""

    def __init__(self, lexicon: str, vocabulary: str) -> None:
        self.lexicon, self.vocabulary = Lexicon(lexicon), vocabulary
        self.find = regex.compile(WORD_PATTERN).findall
        self.ranks: dict[bytes, int] | None = None
        self.merged: dict[bytes, list[int]] = {}

    def _merge(self, word: bytes) -> list[int]:
        ids = self.merged.get(word)
        if ids is None:
            self.ranks = self.ranks or read_ranks(self.vocabulary)
            ids = merge_word(word, self.ranks)
            if len(self.merged) >= CACHED_WORDS:
                self.merged.clear()
            if len(word) <= 4 * LEXICON_WORD_LENGTH:
                self.merged[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ends of the texts among the ids with a leading 0, ids); null and empty texts have none."""
        words: list[str] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words.extend(self.find(t))
            counts[i + 1] = len(words)
        if not words:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        _, ends, data = distinct.buffers()
        offsets = np.frombuffer(ends, np.int64, len(distinct) + 1)
        data = np.frombuffer(data, np.uint8)
        number = self.lexicon.numbers(data, offsets)
        unseen = np.flatnonzero(number < 0)
        extra = [self._merge(data[offsets[i] : offsets[i + 1]].tobytes()) for i in unseen.tolist()]
        held = np.where(number < 0, 0, number)
        start, size = self.lexicon.starts[held].copy(), (self.lexicon.starts[held + 1] - self.lexicon.starts[held]) if len(self.lexicon.ids) else np.zeros(len(held), np.int64)
        size[unseen] = [len(e) for e in extra]
        start[unseen] = len(self.lexicon.ids) + np.cumsum(size[unseen]) - size[unseen]
        pool = np.concatenate([self.lexicon.ids, np.fromiter((i for e in extra for i in e), np.int32)])
        lengths = size[code]
        until = np.cumsum(lengths)
        ids = pool[np.repeat(start[code] - (until - lengths), lengths) + np.arange(until[-1])]
        return np.r_[0, until][counts], ids


def _prepared(texts: DataFrame, text: str, folder: str) -> tuple[str, str]:
    """Names of the lexicon and the vocabulary among the files that Spark sends to the executors."""
    vocabulary = os.path.join(folder, VOCABULARY)
    ranks = read_ranks(vocabulary)
    entries = {w.encode(): merge_word(w.encode(), ranks) for w in frequent_words(texts, text)}
    spark = texts.sparkSession
    with open(vocabulary, "rb") as f:
        return send_file(spark, "lexicon", compile_lexicon(entries)), send_file(spark, "ranks", f.read())


def encode_texts(texts: DataFrame, key: str, text: str, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(`key`, ids) of every row; null and empty texts have the empty list, and strings of special tokens are ordinary text.

    Only the two named columns are read; rows come out as often as they occur. An empty table gives no rows.
    """
    lexicon, vocabulary = _prepared(texts, text, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(lexicon), SparkFiles.get(vocabulary))
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for i, j in _slices(all_texts):
                ends, ids = encoder.encode(all_texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["key", "ids"])

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(F.col(key).alias("key"), text).mapInArrow(encode, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(texts: DataFrame, key: str, text: str, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(`key`, n_tokens) of every row, without carrying the ids."""
    lexicon, vocabulary = _prepared(texts, text, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(lexicon), SparkFiles.get(vocabulary))
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for i, j in _slices(all_texts):
                ends, _ = encoder.encode(all_texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(ends))], ["key", "n_tokens"])

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(F.col(key).alias("key"), text).mapInArrow(count, f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", key)
