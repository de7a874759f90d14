"""Bins, splits and folds with reproducible orders.

Every random order is the order of ``md5(seed:key)``, the same on any engine. Places in such an order are counted by ranges (``ranks``), so
no single task sorts all rows of a table or of a stratum, and tasks grow with the rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .joins import material_pairs
from .mixtures import pairs_of_blocks
from .quantiles import quantiles
from .ranks import placed


#: Room above the expected bound of a sample's digests.
SPARE = 1.0


def digest(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def position(df: DataFrame, order: Column, name: str = "position", by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The place of each row, from 0, in the order of a digest column, within groups ``by``; equal digests sort by ``tie``."""
    return placed(df.withColumn("__o", order), ["__o", *([tie] if tie else [])], name, by).drop("__o")


def quantile_edges(df: DataFrame, value: str, bins: int = 10) -> list[float]:
    """Interpolated inner edges, repeated ones dropped."""
    at = [k / bins for k in range(1, bins)]
    got = quantiles(df, value, at).first()
    return sorted(set(got["__q"])) if got else []


def quantile_bins(df: DataFrame, value: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Equal-frequency bins; ties stay together (W02). The edges come as a scalar aggregate, so the plan has no driver step."""
    at = [k / bins for k in range(1, bins)]
    edges = quantiles(df, value, at).agg(F.array_distinct(F.first("__q")).alias("__e"))  # one row
    return df.join(F.broadcast(edges)).withColumn(name, F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")


def stratified_split(df: DataFrame, key: str, stratum: str, test: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """round(n * test) rows of each stratum are test rows."""
    sizes = df.groupBy(F.col(stratum).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))  # one row for each stratum
    placed = position(df, digest(seed, key), "__p", by=[stratum], tie=key)
    joined = placed.join(sizes, placed[stratum].eqNullSafe(sizes["__t"]))
    return joined.withColumn(name, F.when(F.col("__p") < F.round(F.col("__n") * test), "test").otherwise("train")).select(*df.columns, name)


def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """The first int(n * (1 - test)) rows of the order are train rows."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    placed = position(df, digest(seed, key), "__p").join(F.broadcast(n))
    return placed.withColumn(name, F.when(F.col("__p") < F.floor(F.col("__n") * (1 - test)), "train").otherwise("test")).drop("__p", "__n")


def k_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, balanced: bool = False, name: str = "fold") -> DataFrame:
    """Fold numbers (W05): runs of n // k rows, the last one with the rest, or ``balanced`` ones."""
    placed = position(df, digest(seed, key), "__p")
    if balanced:
        return placed.withColumn(name, (F.col("__p") % k).cast("int")).drop("__p")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    size = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return placed.join(F.broadcast(n)).withColumn(name, F.least(F.floor(F.col("__p") / size), F.lit(k - 1)).cast("int")).drop("__p", "__n")


def repeated_folds(df: DataFrame, key: str, k: int = 5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """(repeat, fold) for every row and repeat; balanced folds of an order of its own for each repeat."""
    out = None
    for r in range(repeats):
        one = k_folds(df, key, k, seed + r, True).withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def sample_pairs(pairs: DataFrame, a: str, b: str, most: int, weights: int, seed: int = 42) -> DataFrame:
    """If pairs x weights exceed ``most``, ``most // weights`` pairs by digest order; all pairs otherwise.

    Digests are spread evenly, so only those below a bound that leaves about four times as many are sorted; all are if too few lie below."""
    n, want = pairs.count(), most // weights
    if n * weights <= most:
        return pairs
    dealt = pairs.withColumn("__d", digest(seed, a, b))
    share = min(1.0, SPARE * (4 * want + 100) / n)
    below = dealt.where(F.col("__d") < f"{int(share * 0xFFFFFFFF):08x}") if share < 1 else dealt
    got = below.orderBy("__d").limit(want)
    if share < 1:
        got = written(got, "sampled")
        if got.count() < want:
            got = dealt.orderBy("__d").limit(want)
    return got.drop("__d")


#: Digests that are computed at once.
AT_ONCE = 65536
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_PLACES = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]


def first_of_md5(words: list) -> np.ndarray:
    """The first 32 bits of the MD5 digests of messages of one block each, given as 16 numbers or arrays of 32 bits that have one shape."""
    shape = next(w.shape for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(shape, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps do not touch the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[_PLACES[i]]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g)
        f >>= np.uint32(32 - _TURNS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def _low_pairs(heads: list[bytes], tails: list[bytes], bound: int):
    """(rows, columns) of heads and tails whose joint MD5 digest begins with a number below ``bound``."""
    by_size = [{n: [i for i, t in enumerate(part) if len(t) == n] for n in {len(t) for t in part}} for part in (heads, tails)]
    for p, rows in by_size[0].items():
        first = np.zeros((len(rows), 64), np.uint8)
        first[:, :p] = np.array([list(heads[i]) for i in rows], np.uint8)
        first = first.view("<u4")
        for q, columns in by_size[1].items():
            rest = np.zeros((len(columns), 64), np.uint8)
            rest[:, p:p + q] = np.array([list(tails[i]) for i in columns], np.uint8)
            rest[:, p + q] = 0x80
            rest[:, 56:64] = np.frombuffer((8 * (p + q)).to_bytes(8, "little"), np.uint8)
            rest = rest.view("<u4")
            used, step = (p + q) // 4 + 1, max(1, AT_ONCE // len(columns))
            for at in range(0, len(rows), step):
                part = first[at:at + step]
                words = [part[:, j, None] | rest[:, j] if j < used else int(rest[0, j]) for j in range(16)]
                for x, y in zip(*np.nonzero(first_of_md5(words) < bound)):
                    yield rows[at + x], columns[y]


def sample_of_all_pairs(rows: DataFrame, key: str, most: int, weights: int, seed: int = 42) -> DataFrame:
    """``sample_pairs`` of all unordered pairs (k1 < k2) of rows, which are not made: tasks take two blocks of keys and keep only the pairs whose digest
    lies below the bound. Keys are of 20 characters at most; all pairs are made if there are few, or if too few lie below."""
    pairs, want = material_pairs(rows, key, key).select("k1", "k2"), most // weights
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    sizes = own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same")).first()
    n = (sizes.n or 0) * ((sizes.n or 0) - 1) // 2 - (sizes.same or 0)
    if n * weights <= most:
        return pairs
    bound = min(2 ** 32 - 1, max(64, int(SPARE * (4 * want + 100) / n * 2 ** 32)))
    left, right = pairs_of_blocks(own)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["k"].to_pylist(), right["k"].to_pylist()
        got = [(a[x], b[y]) for x, y in _low_pairs([f"{seed}:{k}:".encode() for k in a], [str(k).encode() for k in b], bound) if a[x] < b[y]] if a and b else []
        kind = left.schema.field("k").type
        return pa.table([pa.array([x for x, _ in got], kind), pa.array([y for _, y in got], kind)], ["k1", "k2"])

    kind = own.schema["k"].dataType.simpleString()
    low = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"k1 {kind}, k2 {kind}")
    got = written(low.orderBy(digest(seed, "k1", "k2")).limit(want), "sampled")
    return got if got.count() == want else pairs.orderBy(digest(seed, "k1", "k2")).limit(want)
