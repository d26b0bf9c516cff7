"""Token counts against the tokenizer's own library, and what each transducer does by itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import tokencount
from quire.llm.lanes import text_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "s", "t", "r", "e", "l", "v", "m", "d", "'", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", "1", "23", "!", "--", "é", "中", "ي", " the", "ing", " ", "　", "😀", "<|endoftext|>", "<|end", "Ⅷ", "²", "ſ"]


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return tokencount.compiled(f.read())


def counts(counter, texts):
    return counter.counts(*text_bytes(pa.array(texts, pa.string()))).tolist()


def test_counts_equal_the_library(counter, library):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(0, 0x2FF), r.randint(0x3000, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    assert counts(counter, texts) == library(texts)


def test_long_texts_by_windows(counter, library, monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", 200)
    r = random.Random(6)
    texts = ["".join(r.choice(PARTS) for _ in range(5000)), "a" * 3000 + " " * 2000 + "word " * 500, "x" * 1500, " " * 1500, "", "<|endoftext|>" * 100]
    assert counts(counter, texts) == library(texts)


def test_a_full_table_is_begun_anew(library):
    with open(PATH, encoding="utf-8") as f:
        small = tokencount.Counter(f.read(), states=300)
    r = random.Random(7)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(60)]
    assert [counts(small, [t])[0] for t in texts] == library(texts)


def test_maps_compose_as_their_symbols_in_turn():
    r = np.random.default_rng(3)
    symbols = r.integers(0, 11, 3000).astype(np.uint8)
    state, marks = tokencount.END, np.zeros(3001, bool)
    for k, c in enumerate(symbols):
        mark = tokencount.MARKS[c, state]
        marks[k] |= bool(mark & tokencount.HERE)
        if mark & tokencount.BEFORE:
            marks[k - 1] = True
        state = tokencount.NEXT[c, state]
    assert (tokencount.word_marks(symbols) == marks[:-1]).all()


def test_rows_of_any_kind(spark, library):
    long = "It's a long text, of 1,000 words. " * 30_000
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, "", None), (3, None, None), (None, "null key", "y"), (4, long, "z"), (5, "tie <|endoftext|> tie", "z")]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, n_bytes string, n_tokens int")
    got = sorted(tokencount.count_tokens(docs, PATH).collect(), key=str)
    n = library([x[1] or "" for x in rows])
    assert got == sorted([(x[0], len((x[1] or "").encode()), k, k > 1024) for x, k in zip(rows, n, strict=True)], key=str)
    assert tokencount.count_tokens(docs.limit(0), PATH).collect() == []


def test_other_vocabularies_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tokencount.Counter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    n = library([d["text"] or "" for d in docs])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tokencount.op13_count_tokens(spark, sf).collect()) == sorted((d["doc_id"], k) for d, k in zip(docs, n, strict=True))
