import re
from collections import Counter
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

from auxoline.llm import filter_audit as A
from plain import python_free

WIDE = "doc_id long, text string, lang string, `Mask` string, part string, digest string"


def plain_failures(rows):
    out = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        out.append((i, lang or "", {k for k, v in fails.items() if v}))
    return out


def plain_audit(rows, labels):
    marked = plain_failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, taken = {}, Counter()
    for part in {p for _, p, _ in marked}:
        docs = [(i, f) for i, p, f in marked if p == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if f in d[1]]
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                taken[part, f] += len(gone)
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def texts():
    filler = " ".join(f"w{i}" for i in range(120))
    return [
        filler, filler, filler + " #", "UPPER Case TEXT", "short", "", None, "a\x0bb\x0cc\td\re\nf " * 30, "é É ß " * 40, "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, "nul\x00nul | x", "x " * 200_000,
        " ".join(["Wort"] * 21 + [f"w{i}" for i in range(79)]), " ".join(["Wort"] * 20 + [f"w{i}" for i in range(80)]), "    a　b", filler.upper(), filler.upper(), " " + filler,
    ]


def corpus():
    t = texts()
    rows = [(100 - i, x, ("en", "de", None, "")[i % 4], "m", "p", None) for i, x in enumerate(t)]
    rows += [(200 + i, t[i % 5], "en", None, None, "d") for i in range(25)]
    # Repeated rows, one id with two texts, ids that are null.
    return [*rows, rows[0], rows[1], (rows[1][0], "other text", "de", None, None, None), (None, t[0], "en", None, None, None), (None, None, None, None, None, None), (None, t[0], "de", None, None, None)]


def test_matches_plain_filtering_in_every_order(spark):
    rows = corpus()
    labels = [(i, i % 2, i % 3) for i in range(80, 230)] + [(100, None, None), (99, 1, None), (99, 0, 1), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, WIDE).repartition(3)
    out = A.audit(A.failure_counts(A.failures(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), "ABCDE")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert out.count() == len(got) and got == plain_audit(rows, labels)


def test_each_failure_of_each_text(spark):
    rows = corpus()
    got = Counter(tuple(r) for r in A.failures(spark.createDataFrame(rows, WIDE)).select("doc_id", "part", "mask").collect())
    assert got == Counter((i, p, sum(1 << "ABCDE".index(f) for f in fails)) for i, p, fails in plain_failures(rows))


def test_potential_is_the_recursion_and_gives_shapley(spark):
    for n in (1, 3, 5):
        v = [0] + [(s * s * 37 + 11 * s) % 101 for s in range(1, 1 << n)]
        (row,) = A.potentials(spark.createDataFrame([(v,)], "v array<long>"), n).collect()
        p = [Fraction(row.potential[s], factorial(s.bit_count())) for s in range(1 << n)]
        for s in range(1, 1 << n):
            inside = [i for i in range(n) if s >> i & 1]
            # Gains of all members of a coalition sum to its worth: what defines the potential.
            assert sum(p[s] - p[s ^ 1 << i] for i in inside) == v[s]
        whole = (1 << n) - 1
        for i in range(n):
            share = Fraction(0)
            for size in range(n):
                for others in combinations([j for j in range(n) if j != i], size):
                    s = sum(1 << j for j in others)
                    share += Fraction(factorial(size) * factorial(n - size - 1), factorial(n)) * (v[s | 1 << i] - v[s])
            assert p[whole] - p[whole ^ 1 << i] == share


def test_empty_and_whole_numbers_past_32_bits(spark):
    docs, labels = spark.createDataFrame([], WIDE), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(A.failure_counts(A.failures(docs), labels), "ABCDE").count() == 0
    some = spark.createDataFrame([("x", 3, 1 << 40, 0, 0), ("x", 0, 5, 1, 1)], "part string, mask int, n long, good long, toxic long")
    rows = A.audit(some, "AB").collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in rows} == {("AB", 1, 5, 1 << 40, 0, 1 << 40), ("AB", 2, 5, 0, 1 << 40, 1 << 40), ("BA", 1, 5, 1 << 40, 0, 1 << 40), ("BA", 2, 5, 0, 1 << 40, 1 << 40)}


def test_built_in_functions_only(spark):
    assert python_free(A.audit(A.failure_counts(A.failures(spark.createDataFrame(corpus(), WIDE)), spark.createDataFrame([], "doc_id long, quality int, toxic int")), "ABCDE"))
