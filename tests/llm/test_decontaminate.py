import hashlib
import random

from auxoline.llm.decontaminate import TestIndex, decontaminate, flag_contaminated, longest_matches
from plain import ODD, item_words, odd_rows


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Cc", "ré", "日本", "1x"]
    sentence = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "-"]) for _ in range(n))
    tests = [(i, sentence(rng.choice([0, 1, 3, 5, 12]))) for i in range(8)] + [(8, None), (None, sentence(6)), (3, sentence(4))]
    docs = [sentence(rng.choice([0, 2, 30, 200])) for _ in range(40)] + [tests[4][1], "", "?!", sentence(5000)]
    docs += [sentence(3) + (t or "") + sentence(2) for _, t in tests]
    return docs, tests


def expected(text, tests, window):
    w = item_words(text)
    hit, items = set(), set()
    for i, t in tests:
        q = item_words(t)
        for s in range(max(len(q) - window + 1, min(1, len(q)))):
            g = q[s : s + window]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    items.add("" if i is None else str(i))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_hits_match_brute_force_in_one_and_in_many_blocks(spark):
    texts, tests = corpus(1)
    rows = odd_rows(texts)
    docs, items = spark.createDataFrame(rows, ODD), spark.createDataFrame(tests, "item_id long, text string")
    want = sorted(expected(r[1], tests, 5) for r in rows)
    for size in (1 << 20, 60):
        out, names = flag_contaminated(docs, items, window=5, block_bytes=size)
        assert out.columns == [*docs.columns, *names]
        assert sorted(tuple(r) for r in out.select(*names).collect()) == want
    clean = decontaminate(docs, items, window=5)
    assert clean.schema == docs.schema
    assert clean.count() == sum(not w[4] for w in want)


def test_longest_matches(spark):
    texts, tests = corpus(2)
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([t for t in tests if t[0] != 3], "item_id long, text string")
    for size in (1 << 20, 60):
        got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in longest_matches(docs, items, window=3, block_bytes=size).collect()}
        for i, t in tests:
            q = item_words(t)
            if i in (3, None):
                continue
            for s in range(max(len(q) - 3 + 1, min(1, len(q)))):
                best = (0, 0, 0)
                for d, text in enumerate(texts):
                    w = item_words(text)
                    for p in range(len(w)):
                        n = 0
                        while p + n < len(w) and s + n < len(q) and w[p + n] == q[s + n]:
                            n += 1
                        best = max(best, (n, -d, -p))
                found = got.get((str(i), s))
                if best[0] >= 1 and found is not None:
                    assert found == (best[0], -best[1], -best[2])
                else:
                    # Matches of fewer words than the shortest window need not be found.
                    assert best[0] < min(3, len(q)) or found is not None


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], ODD), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = spark.createDataFrame(odd_rows(["a b", "c"]), ODD)
    assert flag_contaminated(none, items)[0].count() == 0
    assert decontaminate(docs, items.limit(0)).count() == docs.count()
    assert longest_matches(docs, items.limit(0)).count() == 0


def test_one_repeated_word_stays_small():
    import time
    import tracemalloc

    import pyarrow as pa

    from auxoline.llm.flat import LOWER, flat_bytes

    index = TestIndex([("1", "a " * 4000), ("2", "a " * 300), ("3", "b " * 12)])
    assert len(index.distinct) == 2
    buf, offsets = flat_bytes(pa.array(["a " * 16_000, "a " * 9, "b " * 10]))
    tracemalloc.start()
    began = time.thread_time()
    counts, hit, doc, item = index.hits(LOWER[buf], offsets)
    assert time.thread_time() - began < 5 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert hit[:16_000].all() and not hit[16_000:16_009].any() and hit[16_009:].all()
    assert sorted(zip(doc.tolist(), item.tolist(), strict=True)) == [(0, 0), (0, 1), (2, 2)]


def test_repeated_items_are_read_once(spark):
    items = spark.createDataFrame([(1, "one two three four five six")] * 500 + [(2, "one two three four five six"), (3, "no match here at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, "nothing")], "doc_id long, text string")
    out, names = flag_contaminated(docs, items, window=5, block_bytes=40)
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1][names[1]], got[1][names[2]], got[2][names[4]]) == (6, 2, False)
