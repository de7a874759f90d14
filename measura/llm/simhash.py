"""SimHash near-duplicates with pivot distance tables.

Fingerprints link at ``radius`` (3) or fewer differing bits. Equal fingerprints are one node. Two fingerprints that
differ in at most 3 bits agree on at least two of five bit blocks, so each node goes to ten buckets, one for each pair
of blocks, and every link lies inside some bucket. In a bucket, distances to reference fingerprints (pivots) are tabled
once; by the triangle inequality a pair whose tables differ by more than the radius in any coordinate cannot link and is
discarded; the survivors are verified bit by bit. A bucket reports only a spanning star of each connected set, never its pairs.
Large buckets are dealt as pairs of chunks. Links between buckets are joined by distributed connected components.

Defined cases: null or blank text has fingerprint zero and links like any other. Rows without an id count as the largest id;
a component of such rows only has a null ``component_id``. Repeated rows share everything. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checked_broadcast, discard, fresh, materialize
from .components import components

LAST = (1 << 63) - 1
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Reference fingerprints: the first words of a fixed multiplicative sequence.
PIVOTS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 1)) % (1 << 64) for k in range(1, 13))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of three-word shingles; lower-cases A-Z only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-3] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(*part) for b in batches for part in by_bytes(b.column(1), 8 << 20)):
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], ["i", "fp", "row", "h"])


def distances(prints: np.ndarray, pivots: tuple[int, ...] = PIVOTS) -> np.ndarray:
    """The pivot table: Hamming distance of each fingerprint to each pivot."""
    return np.stack([np.bitwise_count(prints ^ np.uint64(p)) for p in pivots], axis=1)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets that a[k] and b[k] are in; labels point straight to the smallest index of a set."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label[:] = flat
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def linked_in_groups(group: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group, the index that stands for each row's connected set within its group."""
    n = len(prints)
    label = np.arange(n)
    if n < 2:
        return label
    table = distances(prints)
    last = np.searchsorted(group, group, side="right") - 1
    live = np.arange(n)
    step = 0
    while True:
        step += 1
        live = live[live + step <= last[live]]
        if not len(live):
            return label
        a = live[label[live] != label[live + step]]
        b = a + step
        for k in range(0, table.shape[1], 4):  # a few pivots at a time: most pairs are gone after the first four
            if not len(a):
                break
            near = (np.abs(table[a, k:k + 4].astype(np.int8) - table[b, k:k + 4].astype(np.int8)) <= radius).all(axis=1)
            a, b = a[near], b[near]
        if len(a):
            true = np.bitwise_count(prints[a] ^ prints[b]) <= radius
            _merge(label, a[true], b[true])


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> pa.RecordBatch:
            key = rows[:, :3]
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))]) if len(rows) else np.zeros(0, np.int64)
            label = linked_in_groups(group, rows[:, 3].copy().view(np.uint64), radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rows[moved, 3]), pa.array(rows[label[moved], 3])], ["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            rows = np.concatenate(held) if len(held) > 1 else rows
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [rows[cut:]]
            if cut:
                yield close(rows[:cut])
        if held:
            yield close(np.concatenate(held))

    return run


def near_links(nodes: DataFrame, radius: int = 3, chunk: int = 2048) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of ``nodes`` (column fp) that are linked directly."""
    if radius != 3:
        raise ValueError("the block pairs are made for a radius of 3")
    pairs = list(combinations(BLOCKS, 2))
    keys = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(p) | _mask(q)))).alias("key")) for k, (p, q) in enumerate(pairs)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("x")).select(F.col("x.t").alias("t"), F.col("x.key").alias("key"), "fp")
    large = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * chunk)
    large = materialize(large.select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("c")), "simhash-large")
    dealt = rows.join(checked_broadcast(large), ["t", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("c", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1)).alias("other")
    dealt = dealt.select("t", "key", "fp", "mine", "c", other)
    pair = F.coalesce(F.least("mine", "other") * F.col("c") + F.greatest("mine", "other"), F.lit(0)).cast("long").alias("pair")
    dealt = dealt.select("t", "key", pair, "fp").repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    return dealt.mapInArrow(_bucket_links(radius), "a long, b long")


def _mask(block: tuple[int, int]) -> int:
    return ((1 << block[1]) - 1) << block[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id; and ``first``, true on one row of each component."""
    return _components(docs, id_col, text_col).select(
        F.when(F.col("i") < LAST, F.col("i")).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("rep.i") < LAST, F.col("rep.i")).alias("component_id"), "first")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("i"), F.col(text_col).alias("t"),
                       F.monotonically_increasing_id().alias("row"), F.xxhash64(text_col).alias("h"))
    prints = materialize(rows.mapInArrow(_fingerprints, "i long, fp long, row long, h long"), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.struct("i", "row")).alias("rep")), "simhash-nodes")
    links = materialize(near_links(nodes).distinct(), "simhash-links")
    roots = components(links)
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("rep").alias("rep"))
    of = materialize(placed.select("fp", "root").join(best, "root").select("fp", "rep"), "simhash-of")
    discard(links)
    return prints.join(of, "fp").withColumn("first", (F.col("i") == F.col("rep.i")) & (F.col("row") == F.col("rep.row")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with its own columns."""
    found = _components(docs, id_col, text_col)
    i, h = fresh(docs, "__i", "__h")
    stay = materialize(found.where("first").select(F.col("i").alias(i), F.col("h").alias(h)), "simhash-stay")
    out = docs.withColumns({i: F.coalesce(F.col(id_col), F.lit(LAST)), h: F.xxhash64(text_col)}).join(stay, [i, h], "left_semi")
    if found.groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):  # rows given twice
        out = out.dropDuplicates([i, h])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
