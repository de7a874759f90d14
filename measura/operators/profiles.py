"""Feature profiles and per-entity statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete(df: DataFrame, columns: list[str], how: str = "any") -> DataFrame:
    """Rows without any missing value, or those that are not missing altogether."""
    return df.na.drop(how, subset=columns)


def prune(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Selected columns, and the names that are missing."""
    if keep is not None:
        return df.select(*(c for c in keep if c in df.columns)), [c for c in keep if c not in df.columns]
    return df.drop(*(drop or [])), [c for c in drop or [] if c not in df.columns]


def layer_columns(layers: dict[str, list[str]], components: dict[str, list[str]], layer: str) -> list[str]:
    """The ordered, prefixed columns of a named feature layer (P10)."""
    if layer not in layers:
        raise ValueError(f"unknown layer {layer}")
    return [f"{part}_{c}" for part in layers[layer] for c in components[part]]


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean (W08); NULL for NULL.

    Values are counted first, so tied rows never sort. Approximate quantiles cut a group's values into ranges; exact counts of the
    ranges and a window inside each give exact ranks without gathering a group in one task."""
    known = df.where(F.col(value).isNotNull())
    edges = known.groupBy(*by).agg(F.percentile_approx(value, F.lit([k / 64 for k in range(1, 64)]), F.lit(1000)).alias("__e"))  # a row for each group
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    cut = (counts.join(edges, by) if by else counts.join(F.broadcast(edges))).withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")
    sizes = cut.groupBy(*by, "__b").agg(F.sum("__n").alias("__m"))
    over = (Window.partitionBy(*by) if by else Window).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__b", F.coalesce(F.sum("__m").over(over), F.lit(0)).alias("__s"))
    before = F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = cut.withColumn("__r", F.coalesce(before, F.lit(0))).join(starts, [*by, "__b"])
    ranks = ranks.select(*by, value, (F.col("__s") + F.col("__r") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def _pearson(x: str, y: str):
    """NULL where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, key: str, label: str, features: list[str], least: int = 30) -> DataFrame:
    """Per feature: Pearson and Spearman against the label over complete pairs, valid rows and coverage; NULL below ``least`` rows."""
    long = df.select(key, F.col(label).alias("y"), *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features)).unpivot([key, "y"], features, "feature", "x")
    valid = long.where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(valid, "x", ["feature"], "rx"), "y", ["feature"], "ry")
    total = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    got = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n_valid"), _pearson("x", "y").alias("p"), _pearson("rx", "ry").alias("s"))
    n = F.coalesce("n_valid", F.lit(0))
    return total.join(got, "feature", "left").select("feature", n.alias("n_valid"), (n / F.col("rows")).alias("coverage"),
                                                     F.when(n >= least, F.col("p")).alias("pearson"), F.when(n >= least, F.col("s")).alias("spearman"))


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance): population variances from one aggregate."""
    one = df.agg(*(F.var_pop(c).alias(c) for c in features))
    return one.unpivot([], features, "feature", "variance")


def varying(df: DataFrame, features: list[str], threshold: float = 0.0) -> list[str]:
    row = df.agg(*(F.var_pop(c).alias(c) for c in features)).first()
    return [c for c in features if row[c] is not None and row[c] > threshold]


def effective_states(states: DataFrame, entity: str = "entity", energy: str = "energy", gas: float = 0.0019872041, low: float = 300, high: float = 500, least: int = 5) -> DataFrame:
    """exp of the entropy of Boltzmann weights at two temperatures, their ratio (1 at least), and mean minus lowest energy.
    NULL below ``least`` states. Two passes over an entity's rows, none of them sorted."""
    base = states.groupBy(entity).agg(F.min(energy).alias("e0"), F.avg(energy).alias("mean"), F.count(energy).alias("n"))
    j = states.join(base, entity)
    d = F.col(energy) - F.col("e0")

    def parts(t: float, name: str):
        w = F.exp(-d / (gas * t))
        return [F.sum(w).alias(f"z{name}"), F.sum(w * d / (gas * t)).alias(f"u{name}")]

    s = j.groupBy(entity, "e0", "mean", "n").agg(*parts(low, "a"), *parts(high, "b"))
    # with p = w / z the entropy is ln z + sum(p d / RT)
    a, b = (F.exp(F.log(f"z{x}") + F.col(f"u{x}") / F.col(f"z{x}")) for x in "ab")
    some = F.col("n") >= least
    return s.select(entity, F.when(some, a).alias("states_low"), F.when(some, b).alias("states_high"), F.when(some, F.greatest(b / a, F.lit(1.0))).alias("ratio"),
                    F.when(some, F.col("mean") - F.col("e0")).alias("strain"))


def path_statistics(coords: DataFrame, entity: str = "entity", conf: str = "conf", pos: str = "pos") -> DataFrame:
    """Contour length, mean end-to-end distance and its spread, and <R^2> / (n <l^2>) (A21); steps come from the first conformer."""
    w = Window.partitionBy(entity, conf).orderBy(pos)
    step = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz"), F.lit(0.0))
    stepped = coords.withColumn("l2", step)
    ends = stepped.groupBy(entity, conf).agg(*(F.min_by(c, pos).alias(f"{c}0") for c in "xyz"), *(F.max_by(c, pos).alias(f"{c}1") for c in "xyz"),
                                             F.sum(F.sqrt("l2")).alias("contour"), F.avg("l2").alias("l2"), F.count("l2").alias("steps"))
    r2 = sum(((F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in "xyz"), F.lit(0.0))
    e = ends.withColumn("r2", r2)
    first = F.min_by(F.struct("contour", "l2", "steps"), conf)
    g = e.groupBy(entity).agg(first.alias("f"), F.avg(F.sqrt("r2")).alias("end_to_end"), F.stddev_pop(F.sqrt("r2")).alias("sd"), F.avg("r2").alias("r2"))
    some = F.col("f.steps") > 0
    return g.select(entity, F.col("f.contour").alias("contour"), "end_to_end", F.when(F.col("f.contour") > 0, F.col("end_to_end") / F.col("f.contour")).alias("ratio"),
                    F.when(F.col("end_to_end") > 0, F.col("sd") / F.col("end_to_end")).alias("spread"),
                    F.when(some & (F.col("f.l2") > 0), F.col("r2") / (F.col("f.steps") * F.col("f.l2"))).alias("stiffness"))
