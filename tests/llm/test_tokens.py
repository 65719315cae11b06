import random

import pytest

from massloom.llm.lexicon import Lexicon, compile_lexicon
from massloom.llm.tokens import TOKENIZER_FOLDER, VOCABULARY, count_tokens, encode_texts, frequent_words, merge_word, read_ranks

np = pytest.importorskip("numpy")
TEXTS = ["", None, " ", "\u00a0  x", "<|endoftext|> hi", "I'll  go\t\tnow\n\n\n", "a" * 30_000, "\x1c\x1d a \x85 b", "\u0661\u0662\u0663 \u00b2\u00bd", "e\u0301 \u65e5\u672c\u8a9e", "A" * 30 + " " * 3000 + "b", "x\u200bb\ufeff", "The cell holds the dish. " * 50]


def _reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZER_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [r.ids for r in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(spark):
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x300), rng.randrange(0x300, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(300)]
    texts = TEXTS + odd
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    out = {r.doc_id: list(r.ids) for r in encode_texts(df, "doc_id", "text").collect()}
    assert [out[i] for i in range(len(texts))] == _reference(texts)
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()}
    assert sizes == {i: len(x) for i, x in out.items()}


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(df, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode_texts(df, "doc_id", "text").collect()) == [(0, 0), (1, 1), (1, 1)]


def test_no_word_is_short_enough_for_the_lexicon(spark):
    df = spark.createDataFrame([(1, "a" * 500), (2, "b" * 700)], "doc_id long, text string")
    out = {r.doc_id: list(r.ids) for r in encode_texts(df, "doc_id", "text").collect()}
    assert [out[1], out[2]] == _reference(["a" * 500, "b" * 700])


def test_frequent_words(spark):
    df = spark.createDataFrame([("b b a",), (None,), ("b c",)], "text string")
    assert frequent_words(df, "text", 2) == ["b", " a"]


def test_lexicon_round_trip(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(2000)}
    entries = {w: [rng.randrange(99) for _ in range(rng.randrange(1, 4))] for w in words}
    data = compile_lexicon(entries)
    (tmp_path / "x").write_bytes(data)
    lex = Lexicon(str(tmp_path / "x"))
    assert len(lex.final) < sum(map(len, words)) / 3  # prefixes and suffixes are shared
    asked = sorted(words) + [b"zz", b"ab" * 20, b"", bytes([255])]
    joined = np.frombuffer(b"".join(asked), np.uint8)
    numbers = lex.numbers(joined, np.cumsum([0, *map(len, asked)]))
    for w, n in zip(asked, numbers.tolist(), strict=True):
        assert (lex.ids[lex.starts[n] : lex.starts[n + 1]].tolist() if n >= 0 else None) == entries.get(w)


def test_empty_lexicon(tmp_path):
    (tmp_path / "x").write_bytes(compile_lexicon({}))
    assert Lexicon(str(tmp_path / "x")).numbers(np.frombuffer(b"ab", np.uint8), np.array([0, 1, 2])).tolist() == [-1, -1]


def test_merge_is_by_rank():
    ranks = read_ranks(f"{TOKENIZER_FOLDER}/{VOCABULARY}")
    back = {v: k for k, v in ranks.items()}
    rng = random.Random(8)
    for _ in range(200):
        w = bytes(rng.choice(b"abcdeth in\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        parts = [w[i : i + 1] for i in range(len(w))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[p] for p in parts]
        assert merge_word(w, ranks) == ([ranks[w]] if w in ranks else want)
        assert b"".join(back[i] for i in merge_word(w, ranks)) == w
