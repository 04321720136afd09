"""Benchmark decontamination with suffix arrays of the training text.

Every task sorts the suffixes of its own shard (a chunk of whole documents) by words, and every suffix of the test
items is binary-searched in it: the range of equal prefixes gives all verbatim occurrences of a window, the neighbours of the
insertion point give the longest match and its place. A training suffix whose first words start no test suffix cannot match
``min_words`` words, so it is left out of the shard's array.

The test items are read once. Their size is measured first; they are split by item into blocks of bounded bytes, each block
is broadcast, and documents pass through the blocks one after another without a shuffle.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z (so any non-ASCII byte belongs to a word); they are
compared by 64-bit hashes. Rules: null texts and items have no words; an item of fewer than ``window`` words is one window; equal
items all count; items with a null id count under the empty string. Empty tables give empty results or no hits.
Matches never cross documents. Other columns are carried.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxoline.llm.flat import LOWER, chunks, flat_bytes, mix, span_hashes, word_table, words
from auxoline.llm.frames import fresh
from auxoline.llm.registry import query, table

WINDOW = 10
#: UTF-8 bytes of test items that one broadcast block may hold (a single longer item is a block of its own).
BLOCK_BYTES = 8 << 20
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_IS_WORD = word_table(SEPARATORS)


class TestIndex:
    """Suffixes of one block of test items as numbers of a shared vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        code = {x: k for k, x in enumerate(self.ids)}
        buf, offsets = flat_bytes(pa.array([t for _, t in items], pa.large_string()))
        low = LOWER[buf]
        starts, ends, counts = words(low, offsets, _IS_WORD)
        self.vocabulary, token = np.unique(span_hashes(low, starts, ends), return_inverse=True)
        size = np.diff(counts)
        self.tokens = np.concatenate([token.astype(np.int64) + 1, np.zeros(1, np.int64)])
        item = np.repeat(np.arange(len(items)), size)
        item_end = counts[1:][item]
        left = item_end - np.arange(len(item))
        is_start = (left >= window) | ((left == size[item]) & (size[item] < window))
        self.start = np.flatnonzero(is_start)
        self.end = item_end[self.start]
        self.length = np.minimum(self.end - self.start, window)
        self.item = np.array([code[i] for i, _ in items], np.int64)[item[self.start]] if len(self.start) else np.zeros(0, np.int64)
        self.place = self.start - counts[:-1][item[self.start]] if len(self.start) else self.start
        self.deepest = int((self.end - self.start).max()) if len(self.start) else 0
        self.min_words = int(self.length.min()) if len(self.start) else 0
        self._collapse()
        self.head = min(self.min_words, 4)
        self.heads = np.unique(self._head(self.tokens, self.start)) if self.head else np.zeros(0, np.uint64)

    def _collapse(self) -> None:
        """Equal windows become one: ``distinct`` numbers a test suffix of each, and ``owners`` the set of items that hold it.

        ``item_sets`` lists the sets without repeats, so that a passage of many items is one set for all its windows."""
        self.deep = int(self.length.max()) if len(self.start) else 0
        self.item_sets, self.distinct, self.owners = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.start):
            return
        window = mix(self.length.astype(np.uint64))
        for j in range(self.deep):
            inside = np.flatnonzero(j < self.length)
            window[inside] = mix(window[inside] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[self.tokens[self.start[inside] + j] - 1])
        _, self.distinct, name = np.unique(window, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([name, self.item], 1), axis=0)
        cut = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        sets: dict[bytes, int] = {}
        self.owners = np.zeros(len(self.distinct), np.int64)
        for k, part in enumerate(np.split(pairs[:, 1], cut[1:])):
            key = part.tobytes()
            if key not in sets:
                sets[key] = len(self.item_sets)
                self.item_sets.append(part)
            self.owners[k] = sets[key]

    def _head(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(self.head):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ tokens[at + j].astype(np.uint64)
        return out

    def suffix_array(self, tokens: np.ndarray, depth: int) -> np.ndarray:
        """Places of the shard's suffixes that can match, in suffix order as far as their first ``depth`` words."""
        n = len(tokens) - self.deepest - 1
        ok = tokens[:n] > 0
        for j in range(1, self.head):
            ok &= tokens[j : n + j] > 0
        at = np.flatnonzero(ok)
        heads = self._head(tokens, at)
        slot = np.minimum(np.searchsorted(self.heads, heads), len(self.heads) - 1)
        at = at[self.heads[slot] == heads]
        rank, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        for word in range(depth):
            if not len(open_):
                break
            key = (rank[open_] << 32) | tokens[at[open_] + word]
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            new = np.empty(len(key), bool)
            new[0] = True
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            # A group of ties takes the ranks from its old rank on, so ranks stay those of a full sort.
            base = rank[open_]
            block = np.empty(len(key), bool)
            block[0] = True
            block[1:] = base[1:] != base[:-1]
            block_first = np.flatnonzero(block)[np.cumsum(block) - 1]
            rank[open_] = base + first[group] - block_first
            size = np.diff(np.append(first, len(key)))
            going = tokens[at[open_] + word] > 0
            open_ = open_[(size[group] > 1) & going]
        return at[np.argsort(rank, kind="stable")]

    def compare(self, which: np.ndarray, at: np.ndarray, tokens: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in common of test suffixes and training suffixes, up to ``limit``, and the sign of training minus test."""
        common, sign, open_ = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.arange(len(which))
        while len(open_):
            open_ = open_[common[open_] < limit[open_]]
            diff = tokens[at[open_] + common[open_]] - self.tokens[self.start[which[open_]] + common[open_]]
            sign[open_] = np.sign(diff)
            open_ = open_[diff == 0]
            common[open_] += 1
        sign[common >= limit] = 0
        return common, sign

    def bound(self, which: np.ndarray, array: np.ndarray, tokens: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of every test suffix: the first place whose suffix is not below it (or, upper, is above it)."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(array), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            _, sign = self.compare(which[open_], array[mid], tokens, limit[open_])
            right = sign <= 0 if upper else sign < 0
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        return low

    def shard(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary numbers of a shard's words with a zero after each document, word counts, and the document of each place."""
        starts, ends, counts = words(low, offsets, _IS_WORD)
        hashes = span_hashes(low, starts, ends)
        n_docs = len(offsets) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(counts))
        tokens = np.zeros(len(hashes) + n_docs + self.deepest + 1, np.int64)
        if len(self.vocabulary) and len(hashes):
            slot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            tokens[np.arange(len(hashes)) + doc] = np.where(self.vocabulary[slot] == hashes, slot + 1, 0)
        return tokens, counts, np.repeat(np.arange(n_docs), np.diff(counts) + 1)

    def searched(self, tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard's suffix array, and the test suffixes whose first words occur in it."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        array = self.suffix_array(tokens, depth)
        return array, np.flatnonzero(np.isin(self._head(self.tokens, self.start), self._head(tokens, array)))

    def hits(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word counts, a hit flag per word, and (document, item) pairs without repeats."""
        tokens, counts, doc = self.shard(low, offsets)
        array, which = self.searched(tokens, self.deep)
        # Each different window once; a place of the shard matches at most one of every length.
        window = np.flatnonzero(np.isin(self.distinct, which))
        which = self.distinct[window]
        limit = self.length[which]
        first, last = self.bound(which, array, tokens, limit, False), self.bound(which, array, tokens, limit, True)
        found = last - first
        at = array[np.repeat(first - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())] if found.sum() else np.zeros(0, np.int64)
        edges = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + np.repeat(limit, found), -1)
        covered = np.cumsum(edges)[: len(doc)] > 0
        place = np.arange(int(counts[-1])) + np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
        if not len(at):
            return counts, covered[place], np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = np.unique(np.stack([doc[at], np.repeat(self.owners[window], found)], 1), axis=0)
        sizes = np.array([len(self.item_sets[o]) for o in held[:, 1]])
        pairs = np.unique(np.stack([np.repeat(held[:, 0], sizes), np.concatenate([self.item_sets[o] for o in held[:, 1]])], 1), axis=0)
        return counts, covered[place], pairs[:, 0], pairs[:, 1]

    def longest(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every test suffix found: its number, words matched, document and word place of one longest match (earliest)."""
        tokens, counts, doc = self.shard(low, offsets)
        array, which = self.searched(tokens, self.deepest)
        limit = (self.end - self.start)[which]
        slot = self.bound(which, array, tokens, limit, False)
        best, at = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for beside in (slot, slot - 1):
            ok = np.flatnonzero((beside >= 0) & (beside < len(array)))
            common, _ = self.compare(which[ok], array[beside[ok]], tokens, limit[ok])
            better = common > best[ok]
            best[ok[better]], at[ok[better]] = common[better], array[beside[ok[better]]]
        found = best > 0
        # Of equally long matches the earliest place stands for the shard.
        for k in np.flatnonzero(found):
            same = self.bound(which[k : k + 1], array, tokens, best[k : k + 1], False)[0], self.bound(which[k : k + 1], array, tokens, best[k : k + 1], True)[0]
            at[k] = array[same[0] : same[1]].min()
        which, best, at = which[found], best[found], at[found]
        inside = doc[at]
        return which, best, inside, at - counts[:-1][inside] - inside


def _blocks(tests: DataFrame, item_id: str, text: str, window: int, block_bytes: int):
    """A broadcast index for each block of test items."""
    rows = tests.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("t <> ''").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield tests.sparkSession.sparkContext.broadcast(TestIndex([(r.i, r.t) for r in block], window))


def flag_contaminated(docs: DataFrame, tests: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with five more columns (their names are returned): n_words, n_hit, n_items, items_sha256, contaminated."""
    names = fresh(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    hit_col, item_col = fresh(docs, "_hits", "_items")
    base, state = docs.schema, T.StructType([T.StructField(hit_col, T.BinaryType()), T.StructField(item_col, T.ArrayType(T.StringType()))])
    done = T.StructType([T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()), strict=True)])
    blocks = list(_blocks(tests, item_id, item_text, window, block_bytes))
    out, text_at = docs, docs.columns.index(text)

    def scan(index, last: bool):
        def run(batches):
            known = index.value
            for batch in batches:
                buf, offsets = flat_bytes(batch.column(text_at))
                before = [c.to_pylist() for c in batch.columns[len(base) :]]
                rows = []
                for a, b in chunks(offsets):
                    low = LOWER[buf[offsets[a] : offsets[b]]]
                    counts, hit, in_doc, item = known.hits(low, offsets[a : b + 1] - offsets[a])
                    cut = np.searchsorted(in_doc, np.arange(b - a + 1))
                    for k in range(b - a):
                        mask, ids = hit[counts[k] : counts[k + 1]], [known.ids[i] for i in item[cut[k] : cut[k + 1]]]
                        if before:
                            mask = mask | np.unpackbits(np.frombuffer(before[0][a + k], np.uint8), count=len(mask)).astype(bool)
                            ids = sorted({*ids, *before[1][a + k]})
                        if last:
                            n = int(mask.sum())
                            rows.append((len(mask), n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0))
                        else:
                            rows.append((np.packbits(mask).tobytes(), ids))
                fields = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] if last else [pa.binary(), pa.list_(pa.string())]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(base)], *cols], names=[*base.names, *(names if last else state.names)])

        return run

    for k, index in enumerate(blocks):
        last = k == len(blocks) - 1
        out = out.mapInArrow(scan(index, last), T.StructType([*base.fields, *(done if last else state).fields]))
    return out, names


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the test items, with all their columns."""
    out, names = flag_contaminated(docs, tests, **options)
    return out.filter(~F.col(names[4])).select(*docs.columns)


def longest_matches(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix that starts a window and occurs: item_id, item_word, n_words, doc_id, doc_word of its longest verbatim match.

    Words are numbered from 0. Of equally long matches the smallest (doc_id, doc_word) is given.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("doc_id", given.schema["doc_id"].dataType), T.StructField("doc_word", T.LongType())])

    def search(index):
        def run(batches):
            known = index.value
            for batch in batches:
                ids = batch.column(0)
                buf, offsets = flat_bytes(batch.column(1))
                for a, b in chunks(offsets):
                    which, common, inside, place = known.longest(LOWER[buf[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
                    item = [known.ids[i] for i in known.item[which]]
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(known.place[which]), pa.array(common), ids.take(pa.array(inside + a)), pa.array(place)], names=schema.names)

        return run

    best = None
    for index in _blocks(tests, item_id, item_text, window, block_bytes):
        found = given.mapInArrow(search(index), schema)
        best = found if best is None else best.unionByName(found)
    order = F.struct((-F.col("n_words")).alias("less"), F.col("doc_id").alias("doc_id"), F.col("doc_word").alias("doc_word"))
    return best.groupBy("item_id", "item_word").agg(F.min(order).alias("top")).select("item_id", "item_word", (-F.col("top.less")).alias("n_words"), "top.doc_id", "top.doc_word")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op1_decontaminate", ORACLE)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return flag_contaminated(docs, table(spark, sf_dir, "benchmark"))[0].drop("text")
