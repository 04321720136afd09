import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auxoline.llm import token_counts as C
from plain import ODD, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", " \xa0\x1c", "\x1d \x1e\x1f  \x1c a", "  a  b", "it's they'll we've 'l 'll I'l 'S", "a\x1cb\x1d c\x85d\xa0e  f​ g", "<|endoftext|>x<|endoftext|> <|endoftext", "\n\n\t x\r\n y  ", "日本語 テスト 123½Ⅷ ²", "é é ́", "﻿a \U0001f600\U0001f600 z", "   ", "!!! $$$ ###\n\n\n a", "a" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return C.PrefixCounter(f.read())


def random_texts(n):
    rng = random.Random(1)
    alphabet = [*" '  \n\tsdlreva19é½!.\x1c\x1f\xa0\x85日", "<|endoftext|>", "the", "ing", " th"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(16))) for _ in range(n)]


def test_every_prefix_counts_as_the_library_does(library, counter):
    for text in [*ODD_TEXTS[:-1], *random_texts(600)]:
        prefixes = [text[:i] for i in range(len(text) + 1)]
        assert counter.counts(text) == [len(e.ids) for e in library.encode_batch(prefixes)]


def test_longest_prefix_within_a_limit(counter):
    for text in [*ODD_TEXTS, *random_texts(50)]:
        counts = counter.counts(text)
        for limit in (0, 1, 2, 3, 7, 1000):
            assert counter.fit(text, limit) == max(i for i, c in enumerate(counts) if c <= limit)


def test_full_caches_change_nothing(library, counter):
    with open(PATH, encoding="utf-8") as f:
        small = C.PrefixCounter(f.read(), keep=3)
    for text in random_texts(80):
        assert small.tokens_of(text) == counter.tokens_of(text) == len(library.encode(text).ids)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in C.count_tokens(docs, PATH).collect():
        n = len(library.encode(texts[r.doc_id]).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_odd_rows_and_truncation(spark, counter):
    rows = odd_rows(ODD_TEXTS)
    docs = spark.createDataFrame(rows, ODD)
    got = sorted(map(tuple, C.count_tokens(docs, PATH, limit=5).collect()), key=str)
    assert got == sorted(((r[0], len((r[1] or "").encode()), counter.tokens_of(r[1] or ""), counter.tokens_of(r[1] or "") > 5) for r in rows), key=str)
    stored = C.prefix_counts(docs, PATH).cache()
    assert stored.where("doc_id = 3").first().counts == counter.counts(ODD_TEXTS[3] or "")
    for limit in (0, 2, 9):
        assert sorted(map(tuple, C.truncate(stored, limit).collect()), key=str) == sorted(((r[0], (r[1] or "")[: counter.fit(r[1] or "", limit)]) for r in rows), key=str)
    want = []
    for i, t, *_ in rows:
        for budget in (1, 4):
            n = counter.fit(t or "", budget)
            want.append((i, budget, n, counter.tokens_of((t or "")[:n])))
    assert sorted(map(tuple, C.within_budget(stored, [1, 4]).collect()), key=str) == sorted(want, key=str)
    assert C.count_tokens(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", [" " * 100_000, "\n " * 20_000, "x" * 50_000, "\u00a0" * 30_000 + "end"])
def test_long_runs_are_counted_once(library, counter, text):
    import time

    began = time.thread_time()
    counts = counter.counts(text)
    assert time.thread_time() - began < 10
    assert counts[-1] == counter.tokens_of(text) == len(library.encode(text).ids)
    for n in (1, 77, 12_345, len(text) - 1):
        assert counts[n] == len(library.encode(text[:n]).ids)
    assert max(map(len, counter.totals), default=0) <= C.LONG
