"""Feature selection."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linear
from ..sources.store import written
from .evaluate import compare
from .models import Spec
from .plane import reaches
from .profiles import varying
from .quantiles import quantiles
from .ranks import counts_upto, digamma
from .shapley import model_trees, shapley_ranking
from .splits import digest


#: Rows of one range of an order, and rows that a task deals at once.
RANGE, DEALT = 50_000, 200_000


def with_shadows(df: DataFrame, key: str, features: list[str], seed: int, n: int | None = None) -> DataFrame:
    """Each row with shadows of its features: for each feature another row's value, in an order of the feature's own.

    Rows are placed by digest, and so are the values of each feature by (feature, digest); a row gets those at its own place. The shadows of
    one row come from different rows. Digests are spread evenly, so even ranges of them, a power of two, hold
    about ``RANGE`` rows each at most, and the digests' first letters tell the range. What a task has for
    a range goes there in one piece, is sorted there, and goes on in pieces to the ranges of places, where rows meet their shadows.
    ``n``: the number of rows, if it is known."""
    bits = (max(1, -(-(df.count() if n is None else n) // RANGE)) - 1).bit_length()
    ranges, digits = 1 << bits, max(1, -(-bits // 4))
    orders = [digest(seed, key), *(F.md5(F.concat_ws(":", F.lit(f"{seed}:shadow"), F.lit(str(k)), F.col(key).cast("string"))) for k in range(len(features)))]
    heads = [str(seed), *(f"{seed}:shadow:{k}" for k in range(len(features)))]
    each = F.posexplode(F.array(*(F.substring(d, 1, digits) for d in orders))).alias("k", "head")
    counts = np.zeros((len(orders), ranges), np.int64)
    for r in df.select(each).groupBy("k", "head").count().collect():  # numbers for each order and range, 16 at most
        counts[r.k, int(r.head, 16) * ranges >> 4 * digits] += r["count"]
    starts = np.cumsum(counts, axis=1) - counts
    columns, shadows = df.columns, [f"shadow_{c}" for c in features]

    def sorted_digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        parts = np.frombuffer(data, ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((parts[:, 1], parts[:, 0]))
        return parts[order, 0], order

    def packed(table: pa.Table) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        return out.getvalue().to_pybytes()

    def unpacked(parts: list[bytes]) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts]).combine_chunks()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(b, k, d, rows): for each range and order, the digests and rows (order 0) or values that a task has for it."""
        def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            rows = table.select(range(len(columns)))
            keys = [b"" if x is None else b":" + x.encode() for x in table.column(len(columns) + len(features)).to_pylist()]
            for k, head in enumerate(heads):
                own = rows if k == 0 else table.select([len(columns) + k - 1])
                start = hashlib.md5(head.encode(), usedforsecurity=False)
                found = []
                for x in keys:
                    one = start.copy()
                    one.update(x)
                    found.append(one.digest())
                data = np.frombuffer(b"".join(found), "V16")
                high, order = sorted_digests(data)
                own, data = own.take(order), data[order]
                cuts = np.searchsorted((high >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    i, j = cuts[b], cuts[b + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([k], pa.int32()), pa.array([data[i:j].tobytes()]), pa.array([packed(own.slice(i, j - i))])], ["b", "k", "d", "rows"])

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            if size >= DEALT:
                yield from pieces(held)
                held, size = [], 0
        if size:
            yield from pieces(held)

    def place(table: pa.Table) -> pa.Table:
        """(b, k, p, rows): what lies in one range of digests, in order, cut where a range of places ends; p is the first place."""
        kinds, digests, rows = table["k"].to_pylist(), table["d"].to_pylist(), table["rows"].to_pylist()
        b, out = table["b"][0].as_py(), []
        for k in sorted(set(kinds)):
            mine = [i for i, x in enumerate(kinds) if x == k]
            own = unpacked([rows[i] for i in mine]).take(sorted_digests(b"".join(digests[i] for i in mine))[1])
            at = p = int(starts[k, b])
            while p < at + len(own):
                end = min(at + len(own), (p // RANGE + 1) * RANGE)
                out.append((p // RANGE, k, p, packed(own.slice(p - at, end - p))))
                p = end
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["b", "k", "p", "rows"])

    def meet(table: pa.Table) -> pa.Table:
        """The rows of one range of places with their shadows."""
        pieces = sorted(zip(table["k"].to_pylist(), table["p"].to_pylist(), table["rows"].to_pylist()), key=lambda x: x[:2])
        parts = [unpacked([rows for kind, _, rows in pieces if kind == k]) for k in range(len(heads))]
        return pa.table([c for t in parts for c in t.columns], [*columns, *shadows])

    values = [F.col(c).cast("double").alias(s) for c, s in zip(features, shadows)]
    dealt = df.select(*columns, *values, F.col(key).cast("string").alias("__key")).mapInArrow(deal, "b int, k int, d binary, rows binary")
    there = dealt.groupBy("b").applyInArrow(place, "b int, k int, p long, rows binary")
    return there.groupBy("b").applyInArrow(meet, df.select(*columns, *values).schema)


@dataclass
class Boruta:
    """Decisions by feature (confirmed, tentative, weak, rejected), hits, rounds in which each took part, and median importances."""

    decision: dict[str, str]
    hits: dict[str, int]
    rounds: dict[str, int]
    importance: dict[str, float]

    @property
    def kept(self) -> list[str]:
        """Confirmed and tentative features; all if there are none."""
        return [c for c, d in self.decision.items() if d in ("confirmed", "tentative")] or list(self.decision)


def binomial_tail(hits: int, n: int) -> float:
    """The chance of so many hits or more in n fair draws."""
    return sum(math.comb(n, i) for i in range(hits, n + 1)) / 2 ** n


def discoveries(p: list[float], alpha: float) -> list[bool]:
    """Which of several tests stand at a false discovery rate of ``alpha`` (Benjamini and Hochberg)."""
    ranked = sorted(range(len(p)), key=lambda i: p[i])
    last = max((r for r, i in enumerate(ranked) if p[i] <= alpha * (r + 1) / len(p)), default=-1)
    return [ranked.index(i) <= last for i in range(len(p))]


def boruta(df: DataFrame, key: str, features: list[str], label: str, rounds: int = 100, alpha: float = 0.05, trees: int = 20, seed: int = 100) -> Boruta:
    """All-relevant selection (M18). In each round a feature hits if its forest importance exceeds the best shadow's.

    After each round the undecided features are tested both ways, with a correction for the number of features (false discovery rate) and
    for the number of rounds (Bonferroni). Rejected features leave the forest. Features still open at the end are tentative if their
    median importance exceeds the median of the best shadows, else weak."""
    rows = written(df.select(key, *features, label).na.drop(), "boruta")
    n_rows = rows.count()
    decision, hits, took, history, best = dict.fromkeys(features, ""), dict.fromkeys(features, 0), dict.fromkeys(features, 0), {c: [] for c in features}, []
    for r in range(rounds):
        now = [c for c in features if decision[c] != "rejected"]
        open_ = [c for c in now if not decision[c]]
        if not open_:
            break
        mixed = written(with_shadows(rows, key, now, seed + r, n_rows), "shadows")
        got = Spec("forest", {"numTrees": trees, "seed": r}).fit(mixed, now + [f"shadow_{c}" for c in now], label).importance()
        best.append(max(got[f"shadow_{c}"] for c in now))
        for c in now:
            hits[c], took[c] = hits[c] + (got[c] > best[-1]), took[c] + 1
            history[c].append(got[c])
        n = r + 1
        for word, p in (("confirmed", [binomial_tail(hits[c], n) for c in open_]), ("rejected", [binomial_tail(n - hits[c], n) for c in open_])):
            for c, stands, q in zip(open_, discoveries(p, alpha), p):
                if stands and q <= alpha / n:
                    decision[c] = word
    middle = {c: median(h) if h else 0.0 for c, h in history.items()}
    for c in features:
        decision[c] = decision[c] or ("tentative" if best and middle[c] > median(best) else "weak")
    return Boruta(decision, hits, took, middle)


def neighbour_information(df: DataFrame, features: list[str], label: str, k: int = 3) -> DataFrame:
    """(feature, information): mutual information with the label from nearest neighbours (M19; Kraskov's first estimator).

    Columns are scaled by their deviation. Each row's distance to its k-th neighbour in the plane of feature and label (the larger of both
    differences) is found by tiles of points (``plane``); how many values lie nearer than that in each column alone, by ranges."""
    columns = [*features, label]
    known = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop()
    spread = known.agg(F.count(F.lit(1)).alias("n"), *(F.stddev_pop(f"c{i}").alias(f"c{i}") for i in range(len(columns)))).first()
    scaled = known.select(*((F.col(f"c{i}") / (spread[f"c{i}"] or 1.0)).alias(f"c{i}") for i in range(len(columns))))
    rows, last, parts = written(scaled, "information"), f"c{len(features)}", []
    for i in range(len(features)):
        near = reaches(rows.select(F.col(f"c{i}").alias("x"), F.col(last).alias("y")), k)
        # Values at the very distance do not count.
        parts.append(near.select(F.lit(i).alias("f"), "id", "x", "y", "c", (F.col("reach") * (1 - 1e-10)).alias("reach")))
    found = written(reduce(DataFrame.unionByName, parts), "reaches")
    ends = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), (F.col("side_value") - sign * F.col("reach")).alias("v"), F.lit(sign > 0).alias("strict")) for side, sign in ((0, 1), (1, -1)))))

    def inside(value: str, data: DataFrame, by: list[str]) -> DataFrame:
        asked = found.withColumn("side_value", F.col(value)).select("f", "id", "c", ends.alias("e")).select("f", "id", "c", "e.*")
        got = counts_upto(data, asked, by, "v", "strict", "below")
        return got.groupBy("f", "id").agg(F.max("c").alias("c"), (F.sum(F.when(F.col("side") == 1, F.col("below")).otherwise(-F.col("below")))).alias("n"))

    mean = F.sum(F.col("c") * digamma(F.col("n"))) / F.sum("c")
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"c{i}").alias("v")) for i in range(len(features))))).alias("e")).select("e.*")
    own = inside("x", each, ["f"]).groupBy("f").agg(mean.alias("a"))
    labels = inside("y", rows.select(F.col(last).alias("v")), []).groupBy("f").agg(mean.alias("b"))
    information = digamma(F.lit(float(max(spread.n, 1)))) + digamma(F.lit(float(k))) - F.col("a") - F.col("b")
    got = own.join(labels, "f").select(F.element_at(F.lit(features), F.col("f") + 1).alias("feature"), F.greatest(information, F.lit(0.0)).alias("information"))
    return got


def binned_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, information): mutual information of equal-frequency bins, from one contingency aggregate for all features."""
    columns = [*features, label]
    rows = written(df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop(), "binned")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v")) for i in range(len(columns))))).alias("x")).select("x.*")
    edges = {r.i: sorted(set(r["__q"])) for r in quantiles(long, "v", [k / bins for k in range(1, bins)], ["i"]).collect()}  # bins for each column

    def below(i: int):
        return F.size(F.filter(F.lit([float(e) for e in edges.get(i, [])]).cast("array<double>"), lambda e: e < F.col(f"c{i}")))

    y = below(len(features)).alias("y")
    cells = rows.select(y, F.posexplode(F.array(*(below(i) for i in range(len(features))))).alias("f", "x")).groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    sums = cells.withColumns({"px": F.sum("n").over(Window.partitionBy("f", "x")), "py": F.sum("n").over(Window.partitionBy("f", "y")), "all": F.sum("n").over(Window.partitionBy("f"))})
    got = sums.groupBy("f").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("px") * F.col("py")))).alias("information"))
    return got.select(F.element_at(F.lit(features), F.col("f") + 1).alias("feature"), "information")


def mrmr(df: DataFrame, features: list[str], label: str, k: int, information: Callable = neighbour_information) -> list[str]:
    """Greedy choice by relevance less mean absolute correlation with what is chosen."""
    return [c for c, _, _ in mrmr_steps(df, features, label, k, information)]


def mrmr_steps(df: DataFrame, features: list[str], label: str, k: int, information: Callable = neighbour_information) -> list[tuple[str, float, float]]:
    """The choices of ``mrmr`` in order: (feature, relevance, score when chosen).

    Correlations come from the sums of products, one aggregate; the walk is over numbers by feature."""
    relevance = {r.feature: r.information for r in information(df, features, label).collect()}
    found = linear.sums(df, features, label).get(())
    second = found.centred()[1][:-1, :-1] if found else np.zeros((len(features), len(features)))
    deviation = np.sqrt(np.diag(second))
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.nan_to_num(np.abs(second / np.outer(deviation, deviation)))
    chosen: list[int] = []
    out = []
    while len(chosen) < min(k, len(features)):
        scores = {i: relevance.get(c, 0.0) - (near[i, chosen].mean() if chosen else 0.0) for i, c in enumerate(features) if i not in chosen}
        best = max(scores, key=lambda i: (scores[i], -i))
        chosen.append(best)
        out.append((features[best], float(relevance.get(features[best], 0.0)), float(scores[best])))
    return out


def importance_ranking(df: DataFrame, features: list[str], label: str, k: int, spec: Spec | None = None) -> list[tuple[str, float]]:
    """The k features with the largest mean absolute Shapley values under a tree model (M20): the head of ``shapley_ranking``."""
    fitted = (spec or Spec("random_trees")).fit(df, features, label)
    ranking = shapley_ranking(model_trees(fitted.model, features, df), df)
    return [(r.feature, r.importance) for r in ranking.orderBy("place").limit(k).collect()]


def top_k_curve(df: DataFrame, features: list[str], label: str, ks: list[int], key: str, folds: int, judge: Spec, ranker: Spec | None = None) -> DataFrame:
    """Ranked validations of the k most important features, for each k."""
    ranked = [c for c, _ in importance_ranking(df, features, label, max(ks), ranker)]
    return compare(df, [(f"top_{k}", judge, ranked[:k]) for k in ks if k <= len(ranked)], label, folds, key)


def selection_pipeline(df: DataFrame, key: str, features: list[str], label: str, target: int, many: int = 100, rounds: int = 100) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Variance, Boruta (only above ``many``), mRMR (only above twice the target), Shapley importance; with a log of (stage, before, after)."""
    log = []

    def stage(name: str, now: list[str], after: list[str]) -> list[str]:
        log.append((name, len(now), len(after)))
        return after

    now = stage("variance", features, varying(df, features))
    if len(now) > many:
        now = stage("boruta", now, boruta(df, key, now, label, rounds).kept)
    if len(now) > 2 * target:
        now = stage("mrmr", now, mrmr(df, now, label, 2 * target))
    if len(now) > target:
        now = stage("importance", now, [c for c, _ in importance_ranking(df, now, label, target)])
    return now, log


def selected_rows(df: DataFrame, key: str, chosen: list[str]) -> DataFrame:
    """(key, place, feature, value): the rows' values of the chosen features, in the order of choice."""
    each = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for k, c in enumerate(chosen)))
    return df.select(key, F.explode(each).alias("__x")).select(key, "__x.*")
