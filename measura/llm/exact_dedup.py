"""Exact duplicates by skew-safe combining.

Texts are compared after each run of white space became one space. The full text is a grouping key at every
step: (1) each task groups its own rows (the map side of the aggregate), (2) groups of one digest meet per salt,
(3) the salt winners of hot digests meet globally. Only hot digests get more than one salt; a digest is hot when
it holds more than ``1 / hot_share`` of the rows, so at most ``hot_share`` of them exist and their list is broadcast.

Defined cases: null text counts as empty, so all empty texts are one group. Rows without an id sort last; a group of
such rows only has a null ``keep_id``. Of rows with equal id and text exactly one has ``kept``. An empty table gives no
rows. Other columns, whatever their names, are never read. Two texts with one digest are told apart by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, fresh, materialize

LAST = (1 << 63) - 1


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 10_000,
                salts: int = 64, digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("i"), normalized(F.col(text_col)).alias("t"))
    base = base.withColumn("d", digest(F.col("t")))

    ids = base.select("i", "d", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("s"),
                      F.monotonically_increasing_id().alias("row"))
    ids = materialize(ids, "dedup-ids")
    sizes = materialize(ids.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "row")).alias("first")), "dedup-sizes")
    rows = docs.count()
    hot = sizes.where(F.col("n") > max(64, rows // hot_share)).select("d", F.lit(True).alias("hot"))

    # (1) and (2): the aggregate's map side removes a task's own copies, its reduce side joins those of one salt.
    salted = (base.join(F.broadcast(hot), "d", "left")
              .select("d", "t", "i", F.col("hot").isNotNull().alias("hot"))
              .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("i"), F.lit(salts))).otherwise(F.lit(0)))
              .groupBy("d", "hot", "salt", "t").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n")))
    # A digest that isn't hot is done: its text isn't needed again.
    salted = materialize(salted.select("d", "hot", "i", "n", F.when(F.col("hot"), F.col("t")).alias("t")), "dedup-salted")
    # (3) salt winners of hot digests, by full text.
    merged = salted.where("hot").groupBy("d", "t").agg(F.min("i").alias("i"), F.sum("n").alias("n")).select("d", "i", "n")
    groups = salted.where("not hot").select("d", "i", "n").unionByName(merged)
    per_digest = (groups.groupBy("d").agg(F.count(F.lit(1)).alias("texts"), F.min("i").alias("keep"), F.max("n").alias("n"))
                  .join(sizes.select("d", "first"), "d"))
    per_digest = materialize(per_digest, "dedup-groups")
    out = _labelled(ids, per_digest.where("texts = 1"), ["d"], rows // hot_share)
    if per_digest.where("texts > 1").head(1):  # one digest, several texts
        out = out.unionByName(_collided(base, ids, per_digest.where("texts > 1")))
    discard(salted)
    return out.select(
        F.when(F.col("i") < LAST, F.col("i")).alias(id_col), F.when(F.col("keep") < LAST, F.col("keep")).alias("keep_id"),
        F.col("n").cast("long").alias("group_size"), "kept", F.lower(F.hex("s")).alias("text_sha256"))


def _labelled(ids: DataFrame, groups: DataFrame, on: list[str], many: int) -> DataFrame:
    """Each row with its group. Hot groups, at most ``hot_share``, are joined from a broadcast list."""
    kept = (F.col("i") == F.col("first.i")) & (F.col("row") == F.col("first.row"))
    hot, cold = groups.where(F.col("n") > max(64, many)), groups.where(F.col("n") <= max(64, many))
    large = ids.join(F.broadcast(hot), on)
    small = ids.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return large.unionByName(small).select("i", "keep", "n", kept.alias("kept"), "s")


def _collided(base: DataFrame, ids: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose digest stands for several texts, grouped by the text's own SHA-256 and the text."""
    some = base.join(digests.select("d"), "d", "left_semi").withColumn("s", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
    groups = some.groupBy("s", "t").agg(F.min("i").alias("keep"), F.count(F.lit(1)).alias("n")).select("s", "keep", "n")
    mine = ids.join(digests.select("d"), "d", "left_semi")
    first = mine.groupBy("s").agg(F.min(F.struct("i", "row")).alias("first"))
    return _labelled(mine, groups.join(first, "s"), ["s"], 1 << 62)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows with equal id and text one stays."""
    found = exact_dedup(docs, id_col, text_col, **how)
    i, t = fresh(docs, "__i", "__s")
    stay = materialize(found.where("kept").select(F.coalesce(F.col(id_col), F.lit(LAST)).alias(i), F.unhex("text_sha256").alias(t)), "dedup-stay")
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col), F.lit(LAST)), t: F.unhex(F.sha2(normalized(F.col(text_col)).cast("binary"), 256))})
    out = keyed.join(stay, [i, t], "left_semi")
    if found.where(F.col(id_col).eqNullSafe(F.col("keep_id")) & ~F.col("kept")).head(1):  # rows given twice
        out = out.dropDuplicates([i, t])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
