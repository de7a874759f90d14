"""Packing documents into sequences: dominance reduction, then best fit.

Every document is tokenized and ends with a separator; only documents longer than the capacity are cut. The plan is made
from the histogram of piece lengths alone, which has at most ``capacity`` entries whatever the corpus. (1) Reduction
after Martello and Toth: sets that provably dominate every other way to fill their sequence are fixed for good and leave
the instance, again and again. (2) Best fit, longest first, packs the rest. The plan is a list of runs
(length, first rank, count, sequence, offset); executors look a piece up by its length and its rank among pieces of that length.
Ranks come from (length, bucket) groups and running counts of the groups, so no length gathers in one task.

Defined cases: null text counts as empty; an empty document is its separator alone. Repeated rows are packed once each.
An empty table gives no rows. Other columns are not read. Rows without an id are packed like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, discard, materialize, words_of

#: Words of Latin-1 letters.
LATIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
#: A bin type: lengths in it, and how many such bins.
Runs = list[tuple[int, int, int, int, int]]


def reduce_dominated(count: Counter, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """Fix dominating sets. Returns (set of lengths, times) and what is left.

    For the longest item j let k be how many of the smallest other items fit beside it at once.
    k = 0: j goes alone. Let i be the largest item that fits beside j. If i fills the rest exactly, or k = 1, any other
    company of j can be exchanged for i, so {j, i} dominates. If k = 2 and i is at least as long as the longest pair
    that fits, {j, i} dominates as well. Taking items away only lowers k and the longest pair, and i stays the largest that fits
    while one is left, so a set is fixed as often as both its items last: each step uses up a length, and the number of steps
    depends on the number of lengths alone. Items that no rule covers are left for best fit.
    """
    left = Counter({k: v for k, v in count.items() if v > 0})
    have = sorted(left)  # the lengths left
    fixed: dict[tuple[int, ...], int] = defaultdict(int)

    def fix(times: int, *lengths: int) -> None:
        fixed[lengths] += times
        for x in lengths:
            left[x] -= times
            if not left[x]:
                del left[x]
                have.pop(bisect_left(have, x))

    changed = True
    while changed and left:
        changed = False
        for j in have[::-1]:
            while left[j]:
                rest = capacity - j
                others = [x for x in have[:4] for _ in range(min(left[x] - (x == j), 3))][:3]
                k = sum(total <= rest for total in accumulate(others))  # the smallest others, three are enough to know
                at = bisect_right(have, rest) - 1
                at -= at >= 0 and have[at] == j and left[j] < 2
                best = have[at] if at >= 0 else 0
                if not k:
                    fix(left[j], j)
                elif best == rest or k == 1 or k == 2 and best >= _longest_pair(left, have, j, rest):
                    fix(left[j] // 2 if best == j else min(left[j], left[best]), j, best)
                else:
                    break
                changed = True
    return list(fixed.items()), left


def _longest_pair(left: Counter, have: list[int], j: int, rest: int) -> int:
    """The largest sum of two items other than one j that is at most rest."""
    have = [x for x in have[:bisect_right(have, rest)] if x != j or left[j] > 1]
    best, a, b = 0, 0, len(have) - 1
    while a <= b:
        if have[a] + have[b] > rest:
            b -= 1
        else:
            if a != b or left[have[a]] - (have[a] == j) > 1:
                best = max(best, have[a] + have[b])
            a += 1
    return best


def best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: bins of one content are one entry."""
    open_: dict[int, list[list]] = defaultdict(list)  # free space -> [content, times]
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(left, reverse=True):
        n = left[length]
        for free in sorted(k for k in open_ if k >= length):
            groups = open_.pop(free)
            while groups and n:
                content, times = groups.pop()
                each = free // length
                whole = min(times, n // each)
                if whole:
                    _put(open_, done, content + (length,) * each, whole, free - length * each)
                    n -= whole * each
                if whole < times:
                    if n:
                        _put(open_, done, content + (length,) * n, 1, free - length * n)
                        n, whole = 0, whole + 1
                    if whole < times:
                        groups.append([content, times - whole])
                        break
            if groups:
                open_[free] = groups + open_.get(free, [])
            if not n:
                break
        each = capacity // length
        if n // each:
            _put(open_, done, (length,) * each, n // each, capacity - length * each)
        if n % each:
            _put(open_, done, (length,) * (n % each), 1, capacity - length * (n % each))
    for groups in open_.values():
        done += [(tuple(c), t) for c, t in groups]
    return done


def _put(open_, done, content, times, free) -> None:
    if free:
        open_[free].append([content, times])
    else:
        done.append((content, times))


def plan(count: Counter, capacity: int) -> Runs:
    """(length, first rank, count, first sequence, offset): rank r of a run goes to sequence first + (r - rank)."""
    fixed, left = reduce_dominated(count, capacity)
    used: Counter = Counter()
    runs: Runs = []
    sequence = 0
    for content, times in fixed + best_fit(left, capacity):
        offset = 0
        for length in content:
            runs.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return runs


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes without a printable Latin-1 sign as the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class _Tokens:
    """Ids of whole texts. Word ends and the normalizer's rules never reach across ASCII white space, so ids of a text
    are the ids of its words in order. A run of ASCII punctuation after a Latin-1 letter or digit is a word of its own to the
    tokenizer, so it is cut off first. Each distinct word is tokenized once a task; words of Latin-1 letters only, which the
    normalizer does nothing but lower-case, go straight to the tokenizer's BPE model."""

    KEPT = 200_000  # words remembered, at most

    def __init__(self, path: str):
        self.path, self.tokenizer, self.known, self.letters = path, None, {}, {k: v for k, v in _byte_letters().items() if k != 10}

    def encode(self, words: pa.Array) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of distinct words. Those of Latin-1 letters are lower-cased and spelled in the model's byte letters all at once."""
        plain = pc.match_substring_regex(words, LATIN)
        ascii_only = pc.equal(pc.utf8_length(words), pc.binary_length(words))
        tokenize = self.model.tokenize
        for some in (pc.and_(plain, ascii_only), pc.and_not(plain, ascii_only)):
            own = words.filter(some)
            if not len(own):
                continue
            spelled = "\n".join(_strings(pc.utf8_lower(own)))
            if not spelled.isascii():
                spelled = spelled.encode().decode("latin-1").translate(self.letters)
            yield from _packed(_strings(own), [[t.id for t in tokenize(w)] for w in spelled.split("\n")])
        own = _strings(words.filter(pc.invert(plain)))
        yield from _packed(own, [self.tokenizer.encode(w, add_special_tokens=False).ids for w in own])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.model = self.tokenizer.model
        rows, words = words_of(pc.fill_null(texts, ""))
        if not len(words):
            return [np.zeros(0, "<u4")] * len(texts)
        coded = words.dictionary_encode()
        core, tail = _cut(coded.dictionary)
        units = pa.concat_arrays([core, tail]).dictionary_encode()
        if len(self.known) > self.KEPT:
            self.known.clear()
        known, names = self.known, _strings(units.dictionary)
        known[""] = b""
        new = [k for k, unit in enumerate(names) if unit not in known]
        known.update(self.encode(units.dictionary.take(pa.array(new, pa.int32()))))
        parts = [known[unit] for unit in names]
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        # core and tail of each distinct word, then the words of the texts
        flat, size = _gather(flat, size, np.asarray(units.indices).reshape(2, -1).T.ravel())
        word = np.asarray(coded.indices)
        size = size.reshape(-1, 2).sum(axis=1, dtype=np.int32)
        ids, each = _gather(flat, size, word)
        per_row = np.bincount(rows, weights=each, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_row)[:-1])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _packed(words: list[str], ids: list[list[int]]) -> Iterator[tuple[str, bytes]]:
    data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * 4).tolist()
    return zip(words, (data[a:b] for a, b in zip([0, *ends], ends)))


def _gather(flat: np.ndarray, size: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts ``take`` of a concatenation of parts, and their sizes."""
    first = np.cumsum(size, dtype=np.int32) - size
    each = size[take]
    ends = np.cumsum(each, dtype=np.int32)
    at = np.repeat(first[take] - (ends - each), each)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], each


def _cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lower-cased (A-Z) words without their last run of ASCII punctuation, and those runs. Names in angle bars stay whole."""
    lower = pc.ascii_lower(words)
    parts = pc.extract_regex(lower, r"^(?P<core>.*[a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}])(?P<tail>[!-/:-@\[-`{-~]+)$")
    whole = pc.or_(pc.is_null(parts), pc.match_substring(lower, "<|"))
    core = pc.if_else(whole, words, pc.struct_field(parts, "core"))
    return core, pc.if_else(whole, "", pc.struct_field(parts, "tail"))


def _pieces(path: str, capacity: int, separator: int):
    tokens = _Tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in by_bytes(batch.column(1), 4 << 20):
                part = batch.slice(a, n)
                row, piece, start, length, crc = [], [], [], [], []
                end = np.array([separator], "<u4").tobytes()
                for k, ids in enumerate(tokens(part.column(1))):
                    data = ids.tobytes() + end
                    for p, s in enumerate(range(0, len(ids) + 1, capacity)):
                        cut = data[4 * s:4 * (s + capacity)]
                        row.append(k), piece.append(p), start.append(s), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["i", "piece", "start", "length", "ids_crc32"])

    return run


def _place(runs: Runs):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (np.asarray(batch.column(names.index(c))).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            sequence, offset = table[at, 3] + rank - table[at, 1], table[at, 4]
            keep = [c for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", buckets: int = 256) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity, separator), "i long, piece int, start long, length long, ids_crc32 long")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("i", "piece", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    pieces = materialize(pieces, "pack-pieces")
    groups = materialize(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-groups")
    runs = plan(Counter({r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}), capacity)
    # At most capacity * buckets rows, and a window holds one length's buckets only.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("i", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(first, ["length", "bucket"])
    ranked = ranked.select("i", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own") - 1).alias("rank"))
    out = ranked.mapInArrow(_place(runs), "i long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("i", id_col)
