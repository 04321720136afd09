"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every suffix start whose first LENGTH bytes lie in its document belongs to one bucket, named by the smallest of the hashes of the K-byte
strings in those bytes: equal LENGTH-byte prefixes share a bucket. Neighbouring starts mostly share it too, so they travel
together as one segment of text; a task packs its segments by bucket, sends of equal segments only the earliest and removes the
others at once. K-byte strings that many different segments hold (found by a first pass, at most 1 / HOT_SHARE of them) are taken
last, so a frequent line does not gather its contexts in one bucket.

A bucket is sorted by itself. Segments whose naming string occurs once hold no repeat, equal segments shrink to the earliest. The
ranks of the difference-cover sample of what is left (positions whose residue modulo PERIOD is in COVER) are computed first, by prefix
doubling. Its suffixes are then sorted block by block: by their first PERIOD bytes, and ties by the ranks of the sample
positions at the offset that brings both suffixes onto the cover. Neighbours in that order that share LENGTH bytes (compared byte by byte) are one
class, of which all but the earliest start are repeated.

Rules: null text is empty. Documents are ordered by doc_id, nulls first; rows that share an id are ordered as read. Repeats inside
a document count, matches never cross documents, and strings are judged on the input. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.flat import chunks, flat_bytes, mix, span_hashes
from auxoline.llm.frames import stored
from auxoline.llm.registry import query, table
from auxoline.session import durable

LENGTH = 100
#: Bytes of the strings that name buckets, and of text whose segments a task packs together.
K, PACK = 16, 8 << 20
#: Bytes of segments a bucket is meant to hold, and how many times segments repeat their text on average.
BUCKET_BYTES, SPREAD = 8 << 20, 3.5
#: Share of a task's (and of all) different segments from which a naming string is hot.
HOT_SHARE = 1 / 2000
#: Bytes of text whose segments are found at once, and bytes of text that meet their spans in one group.
STEP, HOME_BYTES = 1 << 18, 8 << 20
#: One chunk of so many is looked at for hot names: every one; tests look at fewer.
HOT_EVERY = 1
#: Stands for a null id, and comes before every other.
NO_ID = -(1 << 62)
#: Suffixes sorted at a time.
BLOCK = 1 << 20
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
_ZSTD = pa.Codec("zstd", 3)


def cover_offset(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """offset[a, b]: the smallest shift that brings residues a and b onto the cover together."""
    on = np.isin(np.arange(2 * period) % period, cover)
    a, b = np.meshgrid(np.arange(period), np.arange(period), indexing="ij")
    both = np.stack([on[a + d] & on[b + d] for d in range(period)], -1)
    assert both.any(-1).all(), "not a difference cover"
    return both.argmax(-1)


_OFFSET = cover_offset()


def text_words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a big-endian number; the buffer must have 8 spare bytes at its end."""
    return np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the given runs, one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def segments(buf: np.ndarray, offsets: np.ndarray, hot: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, number of suffix starts and name of each segment of a chunk of texts.

    A segment is a maximal run of starts whose naming string is the same place of the text, so a text with repeats inside has several
    segments of one name."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    padded = np.zeros(len(buf) + 32, np.uint8)
    padded[: len(buf)] = buf
    word = np.ndarray((len(buf) + 24,), dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64)
    m = len(buf) - k + 1
    h = np.zeros(m, np.uint64)
    for at in range(0, k, 8):
        h = (h ^ word[at : at + m]) * np.uint64(0x9E3779B97F4A7C15 + 2 * at)
        h ^= h >> np.uint64(29)
    h = mix(h) >> np.uint64(33)
    if len(hot):
        slot = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h |= (hot[slot] == h).astype(np.uint64) << np.uint64(31)
    best = h << np.uint64(32) | np.arange(m, dtype=np.uint64)
    width, span = 1, length - k + 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    best = best[:n]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[length - 1 :]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (best[1:] != best[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    first, size = first[inside[first]], size[inside[first]]
    return first, size, (best[first] >> np.uint64(32)).astype(np.uint32)


class Packer:
    """Segments of one stretch of texts with their places, and their packing by bucket."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, rows: np.ndarray, hot: np.ndarray, every: int = 1):
        self.buf, found = buf, []
        for k, (a, b) in enumerate(chunks(offsets, STEP)):
            if k % every == 0:
                first, size, name = segments(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hot)
                same = span_hashes(buf[offsets[a] : offsets[b]], first, first + size + LENGTH - 1)
                found.append((first + offsets[a], size + LENGTH - 1, name, same))
        self.first, self.sizes, self.name, self.same = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint32, np.uint64))
        doc = np.searchsorted(offsets, self.first, side="right") - 1
        self.ids, self.rows, self.at = ids[doc], rows[doc], self.first - offsets[doc]

    def packed(self, buckets: int):
        """(bucket, payload) rows; negative buckets carry spans that are known already.

        Of equal segments only the earliest is sent, the others are repeats of it."""
        order = np.lexsort((self.at, self.rows, self.ids, self.sizes, self.name, self.same))
        later = np.zeros(len(order), bool)
        later[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (self.same, self.name, self.sizes)])
        gone, keep = np.sort(order[later]), np.sort(order[~later])
        if len(gone):
            yield from _spans_by_salt([self.ids[gone], self.rows[gone], self.at[gone], self.at[gone] + self.sizes[gone]], buckets)
        bucket = (self.name[keep] % np.uint32(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in range(buckets):
            mine = keep[by[edge[b] : edge[b + 1]]]
            if len(mine):
                yield b, pack(self.buf[ragged(self.first[mine], self.sizes[mine])], self.sizes[mine].astype(np.uint32), self.name[mine], self.ids[mine], self.rows[mine], self.at[mine])


def _spans_by_salt(gone: list[np.ndarray], buckets: int):
    """Adjacent spans joined, dealt over as many groups as there are buckets by document."""
    ids, rows, start, stop = joined(*gone)
    salt = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    for b in np.unique(salt):
        mine = salt == b
        yield -1 - int(b), pack(*(x[mine] for x in (ids, rows, start, stop)))


def joined(ids: np.ndarray, rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of spans by document: touching and overlapping ones become one. Spans of one length class need not be sorted."""
    order = np.lexsort((start, rows, ids))
    ids, rows, start, stop = ids[order], rows[order], start[order], stop[order]
    if not len(ids):
        return ids, rows, start, stop
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    # The furthest stop so far within a document, by a running maximum that starts anew with each document.
    doc = np.cumsum(new) - 1
    reach = np.maximum.accumulate(stop + doc * (1 << 40)) - doc * (1 << 40)
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], rows[first], start[first], reach[last]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the columns that rise slowly are stored as differences."""
    head, body = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype == np.int64:
            x = np.diff(x, prepend=np.int64(0))
        # Bytes of equal weight together compress best.
        raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
        head.append(f"{x.dtype.str}:{len(x)}")
        body.append(raw)
    whole = b"".join(body)
    mark = ",".join(head).encode()
    return len(mark).to_bytes(4, "little") + mark + len(whole).to_bytes(8, "little") + _ZSTD.compress(whole, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    n = int.from_bytes(value[:4], "little")
    mark, size = value[4 : 4 + n].decode(), int.from_bytes(value[4 + n : 12 + n], "little")
    whole, at, out = _ZSTD.decompress(value[12 + n :], decompressed_size=size, asbytes=True), 0, []
    for kind in mark.split(","):
        dtype, count = kind.split(":")
        bytes_ = np.dtype(dtype).itemsize * int(count)
        raw = np.frombuffer(whole, np.uint8, bytes_, at).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(np.dtype(dtype)).ravel()
        out.append(np.cumsum(raw) if raw.dtype == np.int64 else raw)
        at += bytes_
    return out


def sample_ranks(word: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the cover sample of a text of n bytes by its next 128 bytes at least; sample i is at PERIOD * (i // 5) + COVER[i % 5]."""
    width = len(COVER)
    at = (np.arange(n // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)[None, :]).ravel()
    at = np.minimum(at, len(word) - 9)
    rank = np.unique(word[at].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    tail = np.unique(word[at + 8].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    rank = np.unique(rank << np.uint64(32) | tail, return_inverse=True)[1].astype(np.uint64)
    depth = PERIOD
    while depth < LENGTH:
        # The sample `depth` bytes further on has the same residue.
        step = depth // PERIOD * width
        ahead = np.zeros(len(rank), np.uint64)
        ahead[:-step] = rank[step:] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    return rank


_SLOT = np.zeros(PERIOD, np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def tie_order(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of suffixes by group and, within it, by suffix order; the suffixes of a group share their first PERIOD bytes."""
    def key(which: np.ndarray, shift: int) -> np.ndarray:
        p = at[which] + shift
        return group[which] << np.uint64(32) | rank[p // PERIOD * len(COVER) + _SLOT[p % PERIOD]]

    residue = at % PERIOD
    classes = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    for r, which in enumerate(classes):
        classes[r] = which[np.argsort(key(which, _OFFSET[r, r]), kind="stable")]
    place = np.zeros(len(at), np.int64)
    for a, mine in enumerate(classes):
        place[mine] += np.arange(len(mine))
        for b, other in enumerate(classes):
            if a != b and len(mine) and len(other):
                shift = _OFFSET[a, b]
                place[mine] += np.searchsorted(key(other, shift), key(mine, shift), side="left" if a < b else "right")
    return np.argsort(place, kind="stable")


def repeated_starts(text: np.ndarray, at: np.ndarray, when: np.ndarray) -> np.ndarray:
    """Which of the suffix starts ``at`` share their first LENGTH bytes with one that is earlier by ``when``."""
    padded = np.zeros(len(text) + 2 * LENGTH + 32, np.uint8)
    padded[: len(text)] = text
    word = text_words(padded)
    rank = sample_ranks(word, len(text) + LENGTH)
    flags = np.zeros(len(at), bool)
    head = word[at].astype(np.uint64)
    cuts = np.unique(np.sort(head[:: max(1, len(head) // 4096)])[:: max(1, 4096 * BLOCK // max(len(head), 1))][1:]) if len(head) > BLOCK else np.zeros(0, np.uint64)
    block_of = np.searchsorted(cuts, head, side="right")
    for block in range(len(cuts) + 1):
        mine = np.flatnonzero(block_of == block) if len(cuts) else np.arange(len(at))
        first = head[mine]
        order = np.argsort(first, kind="stable")
        mine, first = mine[order], first[order]
        tied = np.zeros(len(mine), bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        mine, first = mine[tied], first[tied]
        second = word[at[mine] + 8].astype(np.uint64)
        order = np.lexsort((second, first))
        mine, first, second = mine[order], first[order], second[order]
        same = np.zeros(len(mine), bool)
        same[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        tied = same.copy()
        tied[:-1] |= same[1:]
        group = np.cumsum(~same).astype(np.uint64)[tied]
        mine = mine[tied]
        if not len(mine):
            continue
        order = tie_order(at[mine], group, rank)
        mine, group = mine[order], group[order]
        p = at[mine]
        equal = np.flatnonzero(group[1:] == group[:-1])
        for shift in [*range(PERIOD, LENGTH - 8, 8), LENGTH - 8]:
            equal = equal[word[p[equal + 1] + shift] == word[p[equal] + shift]]
        new = np.ones(len(mine), bool)
        new[equal + 1] = False
        first = np.flatnonzero(new)
        earliest = np.minimum.reduceat(when[mine], first)
        flags[mine] = when[mine] > earliest[np.cumsum(new) - 1]
    return flags


def bucket_spans(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Repeated spans (id, row, start, stop) of a bucket's segments."""
    text, sizes, name, ids, rows, at = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
    sizes = sizes.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
    live = np.flatnonzero(count[inverse] > 1)
    same = np.zeros(len(live), np.uint64)
    text_at = np.append(0, np.cumsum(sizes[live]))
    for a, b in chunks(text_at):
        part = text[ragged(starts[live[a:b]], sizes[live[a:b]])]
        same[a:b] = span_hashes(part, text_at[a:b] - text_at[a], text_at[a + 1 : b + 1] - text_at[a])
    order = np.lexsort((at[live], rows[live], ids[live], sizes[live], name[live], same))
    live, same = live[order], same[order]
    later = np.zeros(len(live), bool)
    later[1:] = (same[1:] == same[:-1]) & (name[live][1:] == name[live][:-1]) & (sizes[live][1:] == sizes[live][:-1])
    gone, live = live[later], live[~later]
    spans = [(ids[gone], rows[gone], at[gone], at[gone] + sizes[gone])]
    _, inverse, count = np.unique(name[live], return_inverse=True, return_counts=True)
    live = live[count[inverse] > 1]
    if len(live):
        # Documents in order, so that an earlier start is a smaller number.
        live = live[np.lexsort((at[live], rows[live], ids[live]))]
        doc = np.cumsum(np.append(True, (ids[live][1:] != ids[live][:-1]) | (rows[live][1:] != rows[live][:-1]))) - 1
        size = sizes[live]
        own = np.cumsum(size) - size
        begins = size - LENGTH + 1
        which = np.repeat(np.arange(len(live)), begins)
        p = ragged(own, begins)
        place = p - own[which] + at[live][which]
        flags = repeated_starts(text[ragged(starts[live], size)], p, doc[which] * (1 << 40) + place)
        which, place = which[flags], place[flags]
        spans.append((ids[live][which], rows[live][which], place, place + LENGTH))
    return joined(*(np.concatenate(x) for x in zip(*spans, strict=True)))


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, row, text: rows are numbered (and written, so that the numbers hold) only if ids repeat or are null."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    repeats = given.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1).count()
    return stored(given.withColumn("row", F.monotonically_increasing_id())) if repeats else given.withColumn("row", F.lit(0).cast("bigint"))


def _stretches(batches):
    """(buffer, offsets, ids, rows) of runs of texts of at most PACK bytes; null ids come first."""
    for batch in batches:
        ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        rows = batch.column(1).to_numpy(zero_copy_only=False)
        buf, offsets = flat_bytes(batch.column(2))
        for a, b in chunks(offsets, PACK):
            yield buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], rows[a:b]


def hot_names(rows: DataFrame) -> np.ndarray:
    """Names that hold at least HOT_SHARE of the different segments, by the names that tasks find frequent; at most 1 / HOT_SHARE.

    Every chunk is looked at; names decide only which bucket sorts a segment, never what is found."""

    def count(batches):
        for stretch in _stretches(batches):
            packer = Packer(*stretch, np.zeros(0, np.uint64), HOT_EVERY)
            if not len(packer.name):
                continue
            order = np.lexsort((packer.same, packer.name))
            name, same = packer.name[order], packer.same[order]
            distinct = name[np.append(True, (name[1:] != name[:-1]) | (same[1:] != same[:-1]))]
            names, n = np.unique(distinct, return_counts=True)
            often = n >= max(4, HOT_SHARE * len(distinct))
            total = pa.array([len(distinct)] + [0] * int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.int64(-1), names[often].astype(np.int64))), pa.array(np.append(np.int64(0), n[often])), total], names=["name", "n", "total"])

    found = durable(rows.select("id", "row", "text").mapInArrow(count, "name long, n long, total long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    # The name -1 carries the total.
    total = found.filter("name = -1").first()
    if total is None:
        return np.zeros(0, np.uint64)
    hot = found.filter((F.col("name") >= 0) & (F.col("n") >= max(32, total.total * HOT_SHARE))).select("name").collect()
    return np.sort(np.array([r.name for r in hot], np.uint64))


def repeated_spans(rows: DataFrame, total: int) -> DataFrame:
    """id, row, start, stop of repeated bytes (null ids as NO_ID); spans of one document may overlap. ``total``: bytes of text."""
    spark = rows.sparkSession
    buckets = max(16, math.ceil(total * SPREAD / BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(hot_names(rows))

    def scatter(batches):
        for stretch in _stretches(batches):
            for bucket, payload in Packer(*stretch, hot.value).packed(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])

    def sort(group: pa.Table) -> pa.Table:
        payloads = group.column("payload").to_pylist()
        if group.column("bucket")[0].as_py() < 0:
            spans = tuple(np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
        else:
            spans = bucket_spans(payloads)
        return pa.table([pa.array(x) for x in spans], names=["id", "row", "start", "stop"])

    return rows.select("id", "row", "text").mapInArrow(scatter, "bucket int, payload binary").groupBy("bucket").applyInArrow(sort, "id long, row long, start long, stop long")


def _home(ids: np.ndarray, rows: np.ndarray, homes: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows.astype(np.uint64)) % np.uint64(homes)).astype(np.int32)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept, the remaining bytes.

    Texts meet their spans in groups of some HOME_BYTES of text; they travel packed, so the shuffle is small.
    """
    rows = _numbered(docs, doc_id, text)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    homes = max(16, math.ceil(total / HOME_BYTES))

    def dealt(batches):
        for buf, offsets, ids, order in _stretches(batches):
            home, sizes = _home(ids, order, homes), np.diff(offsets)
            for h in np.unique(home):
                mine = np.flatnonzero(home == h)
                payload = pack(buf[ragged(offsets[mine], sizes[mine])], sizes[mine], ids[mine], order[mine])
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([payload], pa.binary())], names=["home", "payload"])

    def placed(batches):
        for batch in batches:
            ids, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_home(ids, order, homes)), *batch.columns], names=["home", *batch.schema.names])

    def cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
        ids, order, start, stop = joined(*(spans.column(c).to_numpy() for c in ("id", "row", "start", "stop")))
        out = []
        for payload in texts.column("payload").to_pylist():
            buf, sizes, own, own_row = unpack(payload)
            offsets = np.append(0, np.cumsum(sizes))
            for k in range(len(own)):
                whole = buf[offsets[k] : offsets[k + 1]]
                a, b = np.searchsorted(ids, own[k], side="left"), np.searchsorted(ids, own[k], side="right")
                a, b = a + np.searchsorted(order[a:b], own_row[k], side="left"), a + np.searchsorted(order[a:b], own_row[k], side="right")
                edges = np.append(0, np.stack([start[a:b], stop[a:b]], 1).ravel())
                left = b"".join(whole[x:y].tobytes() for x, y in zip(edges[::2], np.append(edges[1::2], len(whole)), strict=True))
                out.append((None if own[k] == NO_ID else int(own[k]), len(whole), len(whole) - len(left), b - a, left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = rows.select("id", "row", "text").mapInArrow(dealt, "home int, payload binary").groupBy("home")
    spans = repeated_spans(rows, total).mapInArrow(placed, "home int, id long, row long, start long, stop long").groupBy("home")
    return texts.cogroup(spans).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
