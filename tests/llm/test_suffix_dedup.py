import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auxoline.llm import suffix_dedup as S
from auxoline.llm.frames import with_ids
from plain import ODD, odd_rows


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of documents in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - S.LENGTH + 1):
            w = b[p : p + S.LENGTH]
            if w in seen:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(w)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, alphabet="abcdé "):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [piece(n) for n in (60, 99, 100, 101, 180, 700)]
    texts = []
    for _ in range(90):
        texts.append("".join(rng.choice([piece(rng.randrange(150)), rng.choice(common)]) for _ in range(rng.randrange(6))))
    return [*texts, *texts[:25], "a" * 350, "ab" * 170, "ab" * 170 + "c", "x" * 99, "", common[5][:100] + common[5][50:300], piece(9) * 30, piece(113) * 5]


@pytest.mark.parametrize("share", [S.HOT_SHARE, 0.002])
def test_matches_brute_force(spark, share, monkeypatch):
    texts = corpus(7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(S, "HOT_SHARE", share)
    monkeypatch.setattr(S, "PACK", 4000)
    monkeypatch.setattr(S, "STEP", 1500)
    monkeypatch.setattr(S, "HOT_EVERY", 2)
    got = S.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex(F.unhex(F.sha2("kept", 256))))).collect()
    assert sorted(map(tuple, got)) == sorted(brute(enumerate(texts)))


def test_repeated_and_null_ids(spark):
    rows = odd_rows([t for t in corpus(3) if t])
    docs = spark.createDataFrame(rows, ODD).coalesce(1)
    got = sorted(map(tuple, S.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == sorted((b[:3] for b in brute(ordered)), key=str)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_names_depend_on_the_window_only():
    text = np.frombuffer(("q" * 40 + "".join(random.Random(1).choices("abcd ", k=600))).encode(), np.uint8)
    def names(buf, hot):
        first, size, name = S.segments(buf, np.array([0, len(buf)]), hot)
        return np.repeat(name, size)
    plain = names(text, np.zeros(0, np.uint64))
    hot = np.unique(plain)[:3].astype(np.uint64)
    for known in (np.zeros(0, np.uint64), hot):
        whole = names(text, known)
        assert len(whole) == len(text) - S.LENGTH + 1
        assert all(names(text[p : p + S.LENGTH], known)[0] == whole[p] for p in range(0, len(whole), 17))
    assert not np.isin(names(text, hot), hot.astype(np.uint32)).all()


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_suffix_order_and_classes(alphabet, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 300)
    rng = random.Random(11)
    text = "".join(rng.choices(alphabet, k=700)) + "".join(rng.choices(alphabet, k=150)) * 3
    buf = np.frombuffer(text.encode(), np.uint8)
    at = np.arange(len(buf) - S.LENGTH + 1)
    when = np.random.default_rng(2).permutation(len(at))
    first = {}
    for p in at:
        w = text[p : p + S.LENGTH]
        first[w] = min(first.get(w, 1 << 60), when[p])
    assert (S.repeated_starts(buf, at, when) == [when[p] > first[text[p : p + S.LENGTH]] for p in at]).all()
    padded = np.zeros(len(buf) + 300, np.uint8)
    padded[: len(buf)] = buf
    rank = S.sample_ranks(S.text_words(padded), len(buf) + S.LENGTH)
    group = np.unique([text[p : p + S.PERIOD] for p in at], return_inverse=True)[1].astype(np.uint64)
    order = S.tie_order(at, group, rank)
    ordered = [text[p : p + S.LENGTH] for p in at[order]]
    assert ordered == sorted(ordered)


def test_cover_and_spans():
    offset = S.cover_offset()
    assert all(((r + offset[r, q]) % S.PERIOD in S.COVER) and ((q + offset[r, q]) % S.PERIOD in S.COVER) for r in range(16) for q in range(16))
    one = np.zeros(4, np.int64)
    ids, rows, start, stop = S.joined(one, one, np.array([50, 0, 10, 200]), np.array([60, 30, 50, 201]))
    assert list(zip(start, stop, strict=True)) == [(0, 60), (200, 201)]
    arrays = [np.array([5, -3, 1 << 50]), np.array([1, 2], np.uint32), np.frombuffer(b"text", np.uint8), np.zeros(0, np.int64)]
    assert all((x == y).all() for x, y in zip(S.unpack(S.pack(*arrays)), arrays, strict=True))


def test_frequent_strings_are_found(spark):
    rng = random.Random(2)
    line = "".join(rng.choices("abcdefgh ", k=60))
    texts = ["".join(rng.choices("ijklmnop ", k=80)) + line + "".join(rng.choices("ijklmnop ", k=80)) for _ in range(300)]
    rows, row = with_ids(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id")
    assert len(S.hot_names(rows.withColumn("row", F.lit(0).cast("long")))) >= 1


def test_names_of_every_chunk_are_counted(spark):
    """A string that is frequent only after a stretch's first chunk is hot all the same."""
    rng = np.random.default_rng(3)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    common = letters(40)
    texts = [letters(S.STEP + 1000)] + ["".join(letters(400) + common for _ in range(500)) for _ in range(2)]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, row long, text string").coalesce(1)
    assert len(S.hot_names(rows)) >= 1
