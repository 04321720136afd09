"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

Dynamic programme over prefixes: the encoding of a piece's prefix ends in exactly one token, namely the one whose pair with the
last token of the shorter prefix encodes to itself. So ``count[i] = count[i - len(token)] + 1`` gives the count at
every prefix of a piece in one pass, without merging and without encoding a prefix again. Pieces (the words the tokenizer's
pattern cuts) are independent, so counts add up along a text; tables of pieces are kept and reused.

The tables answer truncation (:meth:`PrefixCounter.fit`) and budgets (:meth:`PrefixCounter.counts`) directly. The vocabulary
file is a parameter and is read where the task runs, or its content is broadcast (its size is that of one vocabulary).

Rules: null texts are empty and have no tokens. Special strings inside a text are one token each, as the tokenizer's own default
has it. Repeated rows are counted each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxoline.llm.registry import query, table

#: Fixed value: the pattern by which byte-level BPE cuts a text into pieces. White space is Unicode's, without the separators U+001C to U+001F.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKEN_LIMIT = 1024
#: Pieces (and pairs) whose counts a worker keeps: the newest so many, and those before them until the newest are full again.
KEEP = 400_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Characters from which a piece is counted anew each time instead of being kept.
LONG = 256


class PrefixCounter:
    """Prefix tables of one vocabulary (the text of a tokenizer's JSON file)."""

    def __init__(self, vocabulary: str, keep: int = KEEP):
        spec, letters = json.loads(vocabulary), byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pairs = [(as_bytes(x), as_bytes(y)) for x, y in merges]
        number = {token: k for k, token in enumerate(sorted({as_bytes(t) for t in spec["model"]["vocab"]}))}
        self.size = len(number)
        #: Rank of the merge of two tokens, and for each token its halves and the rank that made it (bytes have none).
        self.rank = {(number[x], number[y]): k for k, (x, y) in enumerate(pairs)}
        self.halves, self.made = [None] * self.size, [-1] * self.size
        for k, (x, y) in reversed(list(enumerate(pairs))):
            whole = number[x + y]
            self.halves[whole], self.made[whole] = (number[x], number[y]), k
        # Tokens by their bytes from the last to the first: steps (node, byte) -> node, and the token that ends at a node.
        self.steps: dict[int, int] = {}
        self.ends = [-1]
        for token, k in number.items():
            node = 0
            for byte in reversed(token):
                step = node << 8 | byte
                if (to := self.steps.get(step)) is None:
                    to = self.steps[step] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = k
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.blank = regex.compile(r"\p{White_Space}+").fullmatch
        self.keep, self.totals, self.older, self.pairs, self.spines = keep, {}, {}, {}, ({}, {})

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that lay at its left (0) or right (1) edge while it was merged, newest first, each with the rank that ended it."""
        if (known := self.spines[side].get(token)) is None:
            known, part, end = [], token, NEVER
            while True:
                known.append((part, end))
                if self.halves[part] is None:
                    break
                part, end = self.halves[part][side], self.made[part]
            self.spines[side][token] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        Walks the merges of both back in time: they stay apart if no two parts that met at their border could have been merged
        while both were there. Among equal ranks the left merge comes first.
        """
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (l, l_end), (r, r_end) = a[i], b[j]
            rank = self.rank.get((l, r))
            if rank is not None and rank < l_end and rank <= r_end:
                return False
            if self.made[l] < 0 and self.made[r] < 0:
                return True
            if self.made[l] > self.made[r]:
                i += 1
            else:
                j += 1

    def table(self, piece: bytes) -> list[int]:
        """Token counts of every prefix of a piece, by bytes (n + 1 values)."""
        n, steps, ends, pairs, size = len(piece), self.steps, self.ends, self.pairs, self.size
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            node, start, found = 0, end, []
            while start:
                node = steps.get(node << 8 | piece[start - 1])
                if node is None:
                    break
                start -= 1
                if ends[node] >= 0:
                    found.append((start, ends[node]))
            for start, token in reversed(found):
                if start:
                    pair = last[start] * size + token
                    if (fits := pairs.get(pair)) is None:
                        if len(pairs) >= self.keep:
                            pairs.clear()
                        fits = pairs[pair] = self._fits(last[start], token)
                    if not fits:
                        continue
                counts[end], last[end] = counts[start] + 1, token
                break
            else:
                raise ValueError(f"the vocabulary has no token for {piece[end - 1 : end]!r}")
        return counts

    def total(self, piece: str) -> int:
        if len(piece) > LONG:
            # Rare, and a few of them would fill the memory that short pieces share.
            return self.table(piece.encode())[-1]
        if (known := self.totals.get(piece)) is None:
            if len(self.totals) >= self.keep:
                self.older, self.totals = self.totals, {}
            known = self.older.get(piece)
            self.totals[piece] = known = self.table(piece.encode())[-1] if known is None else known
        return known

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; the flag marks the special ones."""
        if self.special is None or not self.special.search(text):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False)] * (m.start() > at) + [(m.group(), True)]
            at = m.end()
        return out + [(text[at:], False)] * (at < len(text))

    def tokens_of(self, text: str) -> int:
        """Token count of a whole text."""
        known, total = self.totals.get, 0
        for part, special in self.segments(text):
            if special:
                total += 1
                continue
            pieces = self.pieces(part)
            found = list(map(known, pieces))
            if None in found:
                found = list(map(self.total, pieces))
            total += sum(found)
        return total

    def _part_counts(self, part: str) -> list[int]:
        """Counts at every prefix of a part without special strings, by code points (n + 1 values)."""
        out, base, run_base, run = [0], 0, 0, ""
        for piece in self.pieces(part):
            if self.blank(piece):
                # A prefix that ends in a run of white space has the run as one piece.
                run_base, run = (base, "") if not run else (run_base, run)
                table, before = self.table((run + piece).encode()), len(run.encode())
                out += [run_base + table[before + s] for s in accumulate(len(c.encode()) for c in piece)]
                run += piece
            else:
                start = 0
                if run and self.blank(piece[0]):
                    out.append(run_base + self.total(run + piece[0]))
                    start = 1
                if piece[0] == "'" and len(piece) > 2 and piece[1].isalpha():
                    out += [base + sum(map(self.total, self.pieces(piece[:k]))) for k in range(1, len(piece) + 1)]
                else:
                    table, sizes = self.table(piece.encode()), list(accumulate(len(c.encode()) for c in piece))
                    out += [base + table[s] for s in sizes[start:]]
                run = ""
            base += self.total(piece)
        return out

    def counts(self, text: str) -> list[int]:
        """Token counts of every prefix of a text, by code points (n + 1 values). A special string counts once it is complete."""
        out, base, plain = [0], 0, ""
        for part, special in self.segments(text):
            if special:
                # Until it is complete, a special string is ordinary text after what comes before it.
                before = self.tokens_of(plain)
                out += [base - before + c for c in self._part_counts(plain + part[:-1])[len(plain) + 1 :]]
                base, plain = base + 1, ""
                out.append(base)
            else:
                out += [base + c for c in self._part_counts(part)[1:]]
                base, plain = base + self.tokens_of(part), part
        return out

    def fit(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens, from the counts of all prefixes."""
        return longest_within(self.counts(text), limit)


def longest_within(counts: list[int], limit: int) -> int:
    """The last prefix of at most ``limit`` tokens. Counts can fall as a token completes, so the last one is looked for from the end."""
    return next((i for i in range(len(counts) - 1, -1, -1) if counts[i] <= limit), 0)


def _counter(source, kept={}) -> PrefixCounter:  # noqa: B006
    """The worker's counter of a broadcast vocabulary, kept between batches and tasks."""
    if kept.get("id") != source.id:
        kept.clear()
        kept.update(id=source.id, counter=PrefixCounter(source.text.value))
    return kept["counter"]


class Vocabulary:
    """A vocabulary file's text for all tasks."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = spark.sparkContext.broadcast(f.read())
        self.id = uuid.uuid4().hex


def count_tokens(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    given, source = docs.select(doc_id, text), Vocabulary(docs.sparkSession, vocabulary_path)
    schema = T.StructType([T.StructField("doc_id", given.schema[0].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = _counter(source)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.tokens_of(t) for t in texts]
            cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return given.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text and counts, an array with the token count of every prefix by code points (n + 1 values).

    Once stored, any prefix's count is ``counts[n_chars]``; :func:`truncate` and :func:`within_budget` read it. Null texts are empty.
    """
    given, source = docs.select(doc_id, text), Vocabulary(docs.sparkSession, vocabulary_path)
    schema = T.StructType([T.StructField("doc_id", given.schema[0].dataType), T.StructField("text", T.StringType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        counter = _counter(source)
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([t or ""], pa.string()), pa.array([counter.counts(t or "")], pa.list_(pa.int32()))], names=schema.names)

    return given.mapInArrow(run, schema)


def _last_within(limit) -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens; counts can fall as a token completes, so it is looked for from the end."""
    return F.size("counts") - F.array_position(F.transform(F.reverse("counts"), lambda c: c <= limit), True).cast("int")


def truncate(stored: DataFrame, limit: int) -> DataFrame:
    """doc_id and text, the longest prefix of at most ``limit`` tokens, from stored :func:`prefix_counts`: nothing is encoded again."""
    return stored.select("doc_id", F.substring("text", F.lit(1), _last_within(F.lit(limit))).alias("text"))


def within_budget(stored: DataFrame, budgets: list[int]) -> DataFrame:
    """doc_id, budget and n_chars, the longest prefix that each budget pays for, and n_tokens, what that prefix costs; from stored :func:`prefix_counts`."""
    each = stored.select("doc_id", "counts", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets])).alias("budget"))
    return each.select("doc_id", "budget", _last_within(F.col("budget")).alias("n_chars"), "counts").select("doc_id", "budget", "n_chars", F.col("counts")[F.col("n_chars")].alias("n_tokens"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
