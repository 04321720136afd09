"""Near duplicates by MinHash bands with sequential Bayesian verification.

Documents with equal shingle sets are one class. Signatures of classes are cut into bands; classes that share a band are candidates. A
pair is verified by comparing its signatures batch by batch: after each batch the posterior probability that the similarity
reaches the threshold (uniform prior) is looked at, and the pair is dropped once that is below MISS. Survivors are confirmed on
their full shingle sets.

A band with many classes is not expanded into pairs. First every class is paired with the band's pivot (the class with the most copies).
What then is left to find are links between classes of one band of which at least one is not yet in the pivot's component. Such a
class looks for partners by its rarest shingles: sets that reach the threshold share one of their rarest few, where how few follows from both
sizes; sizes fall into narrow classes, so the bound is tight. Entries carry odd sketches (parities of hashed shingles), whose differing bits
never outnumber the shingles that only one set has, so near misses are dropped where they meet and no similar pair is. In a first round every class
asks for its likeliest partners only, which puts most into their component; the second asks for all partners of another component that are left.
Entries of a frequent shingle are dealt over several tasks. So no link between components of classes that
share a band is lost, and the chance that a pair at the threshold shares no band is (1 - t**ROWS)**BANDS: 6e-11 at 0.85.

Rules: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer than ``k`` words has its whole sequence as one
shingle; null texts and texts without words have none and are linked with nothing. Shingles are compared by 64-bit hashes.
Repeated rows are copies of each other. The component's id is its smallest doc_id (null only if all are). Empty tables give empty results.
Other columns are carried by :func:`keep_one`.
"""

from __future__ import annotations

import math
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.components import components, joined
from auxoline.llm.flat import LOWER, chunks, flat_bytes, mix, span_hashes, word_table, words
from auxoline.llm.frames import stored, with_ids
from auxoline.llm.registry import query, table
from auxoline.llm.suffix_dedup import pack, ragged, unpack

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the posterior probability of reaching the threshold below which a pair is dropped.
BATCH, MISS = 16, 1e-8
#: Buckets of the shingle counts that order shingles by rarity, and shingle entries that a group of the partner search should get.
RARITY, GROUP_ENTRIES = 1 << 18, 200_000
#: Entries of one shingle from which they are dealt over several tasks.
HOT_ROWS = 20_000
#: Entries that a task deals out at a time.
DEALT = 1 << 18
#: Ratio of the sizes that one size class holds.
SIZE_STEP = 1.02
SEED = 5
_IS_WORD = word_table(b" \t\n\x0b\x0c\r")
_RANDOM = np.random.default_rng(SEED)
_A, _B = _RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each text."""
    for a, b in chunks(offsets):
        low = LOWER[buf[offsets[a] : offsets[b]]]
        starts, ends, counts = words(low, offsets[a : b + 1] - offsets[a], _IS_WORD)
        h = span_hashes(low, starts, ends)
        n = max(0, len(h) - k + 1)
        whole = np.zeros(n, np.uint64)
        for j in range(k):
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        for i in range(b - a):
            first, last = counts[i], counts[i + 1]
            if last - first >= k:
                yield np.unique(whole[first : last - k + 1])
            elif last > first:
                one = np.full(1, last - first, np.uint64)
                for j in range(first, last):
                    one = mix(one * np.uint64(0xD6E8FEB86659FD93) + h[j])
                yield one
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    top = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(top), 4096):
        out = np.minimum(out, (_A[:, None] * top[None, at : at + 4096] + _B[:, None]).min(1))
    return out


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches, the fewest matching hashes with which a pair stays: P(J >= t | m of n match) >= miss."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # The Beta posterior's tail, as a binomial sum.
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def sketches(docs: DataFrame, row: str, doc_id: str, text: str, k: int) -> DataFrame:
    """id, doc_id, n, s1, s2 (128 bits that name the set) and sig of every document."""
    given = docs.select(F.col(row).alias("id"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            n, s1, s2, sig = [], [], [], []
            for shingles in shingle_sets(*flat_bytes(batch.column(2)), k):
                n.append(len(shingles))
                s1.append(int(mix(shingles).sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if len(shingles) else 0)
                sig.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "doc_id", "n", "s1", "s2", "sig"])

    return given.mapInArrow(run, f"id long, doc_id {docs.schema[doc_id].dataType.simpleString()}, n long, s1 long, s2 long, sig binary")


def full_sets(docs: DataFrame, row: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """id and shingle hashes (sorted, 8 bytes each) of the documents in ``wanted`` (id)."""
    given = docs.select(F.col(row).alias("id"), F.col(text).cast("string").alias("text")).join(wanted, "id", "left_semi")

    def run(batches):
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(*flat_bytes(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    return given.mapInArrow(run, "id long, shingles binary")


def verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``percent``: signatures by batches first, then full sets."""
    least = least_matches(percent / 100)

    def sequential(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
            open_, matches = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for k, fewest in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[open_] += (a[open_, part] == b[open_, part]).sum(1)
                open_ = open_[matches[open_] >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(open_)), batch.column(1).take(pa.array(open_))], names=["a", "b"])

    def exact(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    def beside(frame: DataFrame, what: DataFrame, value: str) -> DataFrame:
        for end in ("a", "b"):
            frame = frame.join(what.select(F.col("id").alias(end), F.col(value).alias(f"{end}_{value}")), end)
        return frame.select("a", "b", f"a_{value}", f"b_{value}")

    likely = beside(pairs, classes, "sig").mapInArrow(sequential, "a long, b long")
    return beside(likely, sets, "shingles").mapInArrow(exact, "a long, b long")


def size_class(n) -> int:
    return int(math.log(n) / math.log(SIZE_STEP) + 1e-9)


def sketch_words(n: int) -> int:
    """64-bit words of the odd sketch of a set of n: a power of two, 2.5 bits a shingle or more."""
    return 1 << max(0, math.ceil(math.log2(max(1, 2.5 * n) / 64)))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in each of the sketch's bits.

    Sketches of two sets differ in no more bits than there are shingles in one set only, so the bound drops no similar pair. The upper half
    folded onto the lower is the sketch of half the size."""
    bits = 64 * sketch_words(len(shingles))
    odd = np.bincount((mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_distances(x: np.ndarray, y: np.ndarray, at: np.ndarray, size: np.ndarray, words_: np.ndarray) -> np.ndarray:
    """Differing bits of the sketches of documents x[i] and y[i], the larger one folded; ``at`` and ``size``: where a document's words are."""
    out = np.zeros(len(x), np.int64)
    kinds = size[x] << 32 | size[y]
    for kind in np.unique(kinds):
        mine = np.flatnonzero(kinds == kind)
        for part in np.array_split(mine, -(-len(mine) * int(max(kind >> 32, kind & 0xFFFFFFFF)) >> 21) or 1):
            both = []
            for doc, n in ((x[part], int(kind >> 32)), (y[part], int(kind & 0xFFFFFFFF))):
                w = words_[at[doc][:, None] + np.arange(n)]
                while w.shape[1] > int(min(kind >> 32, kind & 0xFFFFFFFF)):
                    w = w[:, : w.shape[1] // 2] ^ w[:, w.shape[1] // 2 :]
                both.append(w)
            out[part] = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64)
    return out


def partner_pairs(members: DataFrame, sets: DataFrame, percent: int, best: bool = False, hot: int = HOT_ROWS) -> DataFrame:
    """Pairs (a, b) of different labels, at least one of them searching, whose sets may reach ``percent``.

    ``members``: id, label, searching. Every pair that does reach it is among them, unless ``best`` asks for no more than the likeliest partner of each
    searching class among those that search too, and among the others.
    """
    spark = members.sparkSession
    rows = stored(members.join(sets, "id"))

    def count(batches):
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.bincount((np.frombuffer(value, np.uint64) % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    counts = np.zeros(RARITY, np.int64)
    found = rows.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most RARITY rows
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    rarity = spark.sparkContext.broadcast(counts)
    size = F.octet_length("shingles") / 8
    entries = rows.agg(F.sum(size * F.lit(1 - percent / 100) * F.when(F.col("searching"), F.lit(1 + 16)).otherwise(F.lit(1))).alias("n")).first().n or 0
    groups = max(16, math.ceil(entries / GROUP_ENTRIES))
    need = lambda x, y: -(-percent * (x + y) // (100 + percent))  # noqa: E731  least overlap

    def spread_out(tokens, own, doc, probe):
        """Token, place, share and document of entries: those of a frequent token are dealt over shares, and whoever looks for them asks all."""
        shares = 1 + rarity.value[(tokens % np.uint64(RARITY)).astype(np.int64)] // hot
        place = np.arange(len(tokens))
        if probe:
            again = np.repeat(place, shares)
            return tokens[again], again, ragged(np.zeros(len(tokens), np.int64), shares), own, doc, probe
        return tokens, place, int(mix(np.array([doc], np.uint64))[0] >> np.uint64(8)) % shares, own, doc, probe

    def entries_of(doc, s, searching):
        n = len(s)
        s = s[np.lexsort((s, rarity.value[(s % np.uint64(RARITY)).astype(np.int64)]))]
        yield spread_out(s[: n - -(-percent * n // 100) + 1], size_class(n), doc, 0)
        if searching:
            most = n * 100 // percent
            for c in range(size_class(max(1, -(-n * percent // 100))), size_class(most) + 1):
                smallest = max(-(-n * percent // 100), math.ceil(SIZE_STEP**c - 1e-6), 1)
                prefix = n - need(n, smallest) + 1
                if prefix > 0:
                    yield spread_out(s[:prefix], c, doc, 1)

    def dealt(rows_, out):
        """Payloads by group of some rows (id, label, searching, shingles) and their entries."""
        lengths = np.array([len(r[0]) for r in out])
        token, place, share = (np.concatenate([np.asarray(r[k]) for r in out]) for k in range(3))
        cls, doc, probe = (np.repeat(np.array([r[k] for r in out], np.int64), lengths) for k in range(3, 6))
        key = mix(token * np.uint64(0x9E3779B97F4A7C15) + cls.astype(np.uint64) + (share.astype(np.uint64) << np.uint64(20)))
        group = (key % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[by], prepend=-1))
        ids, label, flag = (np.array([r[k] for r in rows_], np.int64) for k in range(3))
        n, sketches_ = np.array([len(r[3]) for r in rows_], np.int64), [odd_sketch(r[3]) for r in rows_]
        for a, b in zip(first, np.append(first[1:], len(by)), strict=True):
            mine = by[a:b]
            # Each document's sketch travels once with all its entries of a group.
            docs, entry = np.unique(doc[mine], return_inverse=True)
            words_ = np.concatenate([sketches_[d] for d in docs])
            payload = pack(key[mine], place[mine].astype(np.int64), entry.astype(np.int64), probe[mine], ids[docs], label[docs], n[docs], flag[docs], words_)
            yield pa.RecordBatch.from_arrays([pa.array([group[mine[0]]], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])

    def scatter(batches):
        rows_, out, held = [], [], 0
        for batch in batches:
            for id_, label, searching, value in zip(*batch.columns, strict=True):
                s = np.frombuffer(value.as_py(), np.uint64)
                for entry in entries_of(len(rows_), s, searching.as_py()):
                    out.append(entry)
                    held += len(entry[0])
                rows_.append((id_.as_py(), label.as_py(), searching.as_py(), s))
                if held >= DEALT:
                    yield from dealt(rows_, out)
                    rows_, out, held = [], [], 0
        if out:
            yield from dealt(rows_, out)

    def search(group: pa.Table) -> pa.Table:
        parts, before = [], 0
        for payload in group.column("payload"):
            part = unpack(payload.as_py())
            part[2] = part[2] + before
            before += len(part[4])
            parts.append(part)
        key, place, doc, probe, ids, label, n, flag, words_ = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, place, doc, probe = (x[order] for x in (key, place, doc, probe))
        size = np.array([sketch_words(int(k)) for k in n], np.int64)
        at = np.cumsum(size) - size
        index, look = np.flatnonzero(probe == 0), np.flatnonzero(probe == 1)
        first, last = np.searchsorted(key[index], key[look], side="left"), np.searchsorted(key[index], key[look], side="right")
        found = [np.zeros(0, np.int64)]
        # A bounded number of pairs at a time.
        for a, b in chunks(np.append(0, np.cumsum(last - first)), 1 << 19):
            x = np.repeat(look[a:b], (last - first)[a:b])
            y = index[ragged(first[a:b], (last - first)[a:b])]
            dx, dy = doc[x], doc[y]
            ok = (label[dx] != label[dy]) & (100 * np.minimum(n[dx], n[dy]) >= percent * np.maximum(n[dx], n[dy]))
            ok &= np.minimum(n[dx] - place[x], n[dy] - place[y]) >= need(n[dx], n[dy])
            pair = np.unique(dx[ok] * before + dy[ok])
            dx, dy = pair // before, pair % before
            far = sketch_distances(dx, dy, at, size, words_)
            found.append(pair[far <= n[dx] + n[dy] - 2 * need(n[dx], n[dy])])
        pair = np.unique(np.concatenate(found))
        dx, dy = pair // max(1, before), pair % max(1, before)
        far = sketch_distances(dx, dy, at, size, words_) * 1_000_000 // np.maximum(1, n[dx] + n[dy])
        if best:
            by = np.lexsort((ids[dy], far, flag[dy], dx))
            dx, dy, far = dx[by], dy[by], far[by]
            keep = np.ones(len(dx), bool)
            keep[1:] = (dx[1:] != dx[:-1]) | (flag[dy][1:] != flag[dy][:-1])
            dx, dy, far = dx[keep], dy[keep], far[keep]
        return pa.table([pa.array(ids[dx]), pa.array(ids[dy]), pa.array(flag[dy]), pa.array(far)], names=["a", "b", "flag", "far"])

    given = rows.select("id", "label", "searching", "shingles")
    pairs = given.mapInArrow(scatter, "bucket int, payload binary").groupBy("bucket").applyInArrow(search, "a long, b long, flag long, far long")
    if best:
        pairs = pairs.groupBy("a", "flag").agg(F.min(F.struct("far", "b")).alias("top")).select("a", "top.b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _searching(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """id, label (its component so far) and searching, of the classes in bands (band, id, pivot) whose members are not of one component yet."""

    def label(column: str) -> DataFrame:
        return roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))

    both = crowded.join(label("id"), "id", "left").join(label("pivot"), "pivot", "left")
    labelled = stored(both.select("band", "id", F.coalesce("id_root", "id").alias("label"), F.coalesce("pivot_root", "pivot").alias("main")))
    mixed = labelled.filter("label <> main").select("band").distinct()
    return stored(labelled.join(mixed, "band", "left_semi").groupBy("id").agg(F.max("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("searching")))


def near_classes(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: id (``row``), doc_id, n_shingles, component_id (the smallest doc_id) and first (its row's id)."""
    sketch = stored(sketches(docs, row, doc_id, text, k))
    same = sketch.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    member = stored(sketch.select("id", "doc_id", "n", "s1", "s2").join(same, ["s1", "s2", "n"], "left").select("id", "doc_id", "n", F.coalesce("class", "id").alias("class"), "copies"))
    classes = stored(sketch.select("id", "sig").join(member.filter("id = class and n > 0").select("id", "copies"), "id"))
    key = F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])).alias("band")
    bands = classes.select("id", "copies", key)
    top = F.min(F.struct((-F.col("copies")).alias("less"), F.xxhash64("id").alias("h"), F.col("id").alias("pivot")))
    shared = bands.groupBy("band").agg(top.alias("top"), F.count("*").alias("size")).filter("size > 1").select("band", "top.pivot", "size")
    inside = stored(bands.select("band", "id").join(shared, "band"))
    sets = stored(full_sets(docs, row, text, k, inside.select("id").distinct()))
    stars = inside.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    roots = components(verify(stars, classes, sets, percent))
    crowded = inside.filter("size > 2").select("band", "id", "pivot")
    # The likeliest partners first: most classes are in their component then, and need not look at all that may be similar.
    for best in (True, False):
        members = _searching(crowded, roots)
        if members.filter("searching").limit(1).count():
            roots = joined(roots, verify(partner_pairs(members, sets, percent, best), classes, sets, percent))
    rooted = member.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("id", "doc_id", "n", F.coalesce("root", "class").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("id"))).alias("top"))
    return rooted.join(best, "root").select("id", "doc_id", F.col("n").alias("n_shingles"), F.col("top.doc_id").alias("component_id"), F.col("top.id").alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id is the component's)."""
    numbered, row = with_ids(docs.select(doc_id, text), doc_id)
    out = near_classes(numbered, row, doc_id, text, k, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns; documents without words all stay."""
    numbered, row = with_ids(docs, doc_id)
    gone = near_classes(numbered, row, doc_id, text, k, percent).filter("id <> first").select(F.col("id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT * FROM s SEMI JOIN f USING (g)) a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op9_near_dedup", ORACLE)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
