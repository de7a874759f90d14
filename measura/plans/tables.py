"""Queries of sources, keys, resolution and quality (S, P, A, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..operators import featurize, joins, quality, resolve, splits
from ..sources import Column_, SourceSpec, load_all, materialize_once, read_delimited, read_unified, resolve_column, scratch, write_report, write_unified
from ..sources.delimited import read_with_order
from ..sources.specs import conform
from .registry import query
from .views import DOCS, MEAS, ORDER, duck, table, view

M, D = f"({duck(MEAS)})", f"({duck(DOCS)})"
ROWS = ", ".join(ORDER)


def meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MEAS)


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


# Sources and sinks: tables are written as text files and read back.

@query("s01_read_delimited", "SELECT CAST(s_suppkey AS varchar) AS s_suppkey, s_name, CAST(s_nationkey AS varchar) AS s_nationkey FROM supplier")
def s01(spark, sf_dir):
    path = scratch(spark, "s01")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return read_delimited(spark, path)


CUSTOMER = SourceSpec("customers", 0, {
    "key": Column_(("code", "c_name"), required=True), "value": Column_(("c_acctbal",), "double", required=True, convert=lambda v: v + 273.15),
    "class": Column_(("segment", "c_mktsegment"))}, {"reliability": "measured"})


@query("s02_conform", """SELECT c_name AS key, round(c_acctbal + 273.15, 4) AS value, c_mktsegment AS "class", 'measured' AS reliability, 'customers' AS source, 0 AS priority FROM customer""")
def s02(spark, sf_dir):
    path = scratch(spark, "s02")
    table(spark, sf_dir, "customer").select("c_name", "c_acctbal", "c_mktsegment").write.option("header", True).option("sep", "\t").csv(path)
    return conform(read_delimited(spark, path, "\t"), CUSTOMER).withColumn("value", F.round("value", 4))


@query("s03_resolve_column", "SELECT 'p_retailprice' AS col_name, count(p_retailprice) AS n, round(avg(p_retailprice), 4) AS mean FROM part")
def s03(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    c = resolve_column(df, "PRICE")
    return df.agg(F.lit(c).alias("col_name"), F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"))


SPECS = [
    SourceSpec("suppliers", 0, {"key": Column_(("s_name",), required=True), "value": Column_(("s_acctbal",), "double", required=True)}),
    SourceSpec("customers", 1, {"key": Column_(("c_name",), required=True), "value": Column_(("c_acctbal",), "double", required=True)}),
    SourceSpec("parts", 2, {"key": Column_(("p_name",), required=True), "value": Column_(("p_retailprice",), "double", required=True)}),
]


@query("s04_load_all", """SELECT source, count(*) AS n, round(sum(value), 2) AS total FROM (
    SELECT 'suppliers' AS source, s_acctbal AS value FROM supplier UNION ALL SELECT 'customers', c_acctbal FROM customer) WHERE value BETWEEN 100 AND 9000 GROUP BY source""")
def s04(spark, sf_dir):
    tables = {"suppliers": table(spark, sf_dir, "supplier"), "customers": table(spark, sf_dir, "customer"), "parts": table(spark, sf_dir, "part")}
    df = load_all(tables, SPECS, low=100, high=9000, leave_out=("parts",))
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s05_load_order", f"SELECT key, value, source FROM {M} QUALIFY row_number() OVER (PARTITION BY key ORDER BY {ROWS}) = 1")
def s05(spark, sf_dir):
    return resolve.first_rows(meas(spark, sf_dir), ORDER).select("key", "value", "source")


@query("s05_file_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def s05_file(spark, sf_dir):
    path = scratch(spark, "s05")
    table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    df = read_with_order(spark, path)
    # places by file first, then inside each file: no task sorts all rows
    at = df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("src_row.file_path").alias("f"), "src_row")
    own = F.row_number().over(splits.Window.partitionBy("f").orderBy("src_row")) - 1
    sizes = at.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(splits.Window.orderBy("f").rowsBetween(splits.Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("own", own).join(F.broadcast(sizes.select("f", first.alias("first"))), "f").select("o_orderkey", (F.col("first") + F.col("own")).alias("place"))


@query("s06_unified_store", f"SELECT key, value, source FROM {M} WHERE source = 'R'")
def s06(spark, sf_dir):
    path = scratch(spark, "s06")
    write_unified(meas(spark, sf_dir).select("key", "value", F.col("source").alias("split")), path)
    return read_unified(spark, path, "R").select("key", "value", F.col("split").alias("source"))


@query("s07_report", "SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY o_orderstatus")
def s07(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")).alias("stats"))
    path = scratch(spark, "s07")
    write_report(df, path)
    return spark.read.schema(df.schema).json(path).select("status", "stats.n", "stats.mean")


@query("s08_materialize_once", "SELECT l_partkey, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY l_partkey")
def s08(spark, sf_dir):
    root = scratch(spark, "s08")

    def make() -> DataFrame:
        return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("q"))

    materialize_once(spark, make, root, "quantity by part", "1")
    return materialize_once(spark, make, root, "quantity by part", "1")


DONE = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("score", T.DoubleType())])


@query("s09_incremental_apply", "SELECT o_orderkey, o_totalprice * 2 AS score FROM orders WHERE o_orderkey % 10 <> 3")
def s09(spark, sf_dir):
    path, df = scratch(spark, "s09"), table(spark, sf_dir, "orders")

    def work(rows: DataFrame) -> DataFrame:
        return rows.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice") * 2).alias("score"))

    featurize.incremental_apply(spark, df.where("o_orderkey % 2 = 0"), "o_orderkey", path, work, DONE)
    return featurize.incremental_apply(spark, df, "o_orderkey", path, work, DONE)


@query("s10_profile_table", """SELECT count(*) AS n, count(try_cast(split_part(split_part(CAST(c_acctbal AS varchar), ' ', 1), '-', 1) AS double)) AS parsed,
    'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, 'c_custkey,c_nationkey' AS key_columns, 'c_acctbal' AS value_columns FROM customer""")
def s10(spark, sf_dir):
    return quality.profile_table(table(spark, sf_dir, "customer"), "c_acctbal", "key", "bal")


@query("s11_generate_series", """SELECT r_name || '-' || n_name AS name, greatest(320, 420 - 10 * n_nationkey) AS t, repeat('C', n_nationkey) || 'O' AS unit
    FROM region JOIN nation ON n_regionkey = r_regionkey""")
def s11(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("n_nationkey")
    return j.select(F.concat("r_name", F.lit("-"), "n_name").alias("name"), F.greatest(F.lit(320), 420 - 10 * n).alias("t"), F.concat(F.expr("repeat('C', n_nationkey)"), F.lit("O")).alias("unit"))


@query("s11_family_rows", """SELECT n_nationkey AS n, segment, segment || '-' || n_name AS name, greatest(320, 420 - 10 * n_nationkey) AS t,
    (n_nationkey + length(segment)) // 2 + 10 AS middle, repeat('C', n_nationkey::int) || 'O' AS unit FROM nation, (SELECT DISTINCT c_mktsegment AS segment FROM customer)""")
def s11_family(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), "n_name")
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    n = F.col("n")
    return joins.generate_series([nations, segments], {
        "name": F.concat("segment", F.lit("-"), "n_name"), "t": F.greatest(F.lit(320), 420 - 10 * n), "middle": F.expr("(n + length(segment)) div 2 + 10"),
        "unit": F.concat(F.expr("repeat('C', cast(n as int))"), F.lit("O"))}).drop("n_name")


@query("s10_first_rows", """SELECT count(*) AS n, (SELECT string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ';' ORDER BY c_custkey) FROM
    (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)) AS first_rows FROM customer""")
def s10_first(spark, sf_dir):
    got = quality.profile_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", first=5, order=["c_custkey"])
    return got.select("n", F.array_join("first_rows", ";").alias("first_rows"))


# Keys and predicates.

STAR = "CASE WHEN doc_id % 3 = 0 THEN '*' || key || '[*]' ELSE key END"


def starred(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, DOCS).withColumn("raw", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("*"), "key", F.lit("[*]"))).otherwise(F.col("key")))


@query("p01_normalize_key", f"SELECT doc_id, replace(replace(trim({STAR}), '[*]', '*'), '*', '[*]') AS norm, replace(trim({STAR}), '[*]', '*') AS plain FROM {D}")
def p01(spark, sf_dir):
    n = keys.normalize_key(F.col("raw"))
    return starred(spark, sf_dir).select("doc_id", n.alias("norm"), keys.plain_key(n).alias("plain"))


@query("p02_canonical_key", f"SELECT doc_id, CASE WHEN length(key) >= 20 THEN 'k:' || key ELSE key END AS canon, length(key) >= 20 AS valid FROM {D}")
def p02(spark, sf_dir):
    def canonical(c):
        return F.when(F.length(c) >= 20, F.concat(F.lit("k:"), c))

    return view(spark, sf_dir, DOCS).select("doc_id", keys.canonical_key(F.col("key"), canonical).alias("canon"), keys.is_valid_key(F.col("key"), canonical).alias("valid"))


@query("p03_has_marker", f"SELECT contains(key, '*') AS marked, count(*) AS n FROM {D} GROUP BY 1")
def p03(spark, sf_dir):
    return view(spark, sf_dir, DOCS).groupBy(keys.has_marker(F.col("key")).alias("marked")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_over_precise", r"""SELECT o_orderkey, coalesce(length(regexp_extract(rtrim(txt, '0'), '\.(\d+)$', 1)) > 1, false) AS precise
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS decimal(18, 2)) AS varchar) || '00' END AS txt FROM orders)""")
def p04(spark, sf_dir):
    txt = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.over_precise(txt, 1).alias("precise"))


@query("p05_rejection_counts", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN 'too_large' WHEN p_retailprice < 1000 THEN 'cheap' END AS reason FROM part) GROUP BY reason")
def p05(spark, sf_dir):
    reason = keys.first_reason({"too_large": F.col("p_size") > 40, "cheap": F.col("p_retailprice") < 1000})
    return table(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p06_unit_inference", "SELECT p_partkey, CASE WHEN p_retailprice < 1200 THEN p_retailprice + 273.15 ELSE p_retailprice END AS kelvin FROM part")
def p06(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", keys.to_kelvin(F.col("p_retailprice"), 1200).alias("kelvin"))


@query("p07_range_filter", f"SELECT source, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM {M} WHERE value BETWEEN 1000 AND 1500 GROUP BY source")
def p07(spark, sf_dir):
    return resolve.in_range(meas(spark, sf_dir), 1000, 1500).groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(F.min("value")).alias("low"), r(F.max("value")).alias("high"))


@query("p11_mixture_flag", """SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_quantity > 45 THEN 100 ELSE l_quantity END) < 100 AND l_linestatus <> 'O' AS mixture FROM lineitem""")
def p11(spark, sf_dir):
    ratio = F.when(F.col("l_quantity") > 45, F.lit(" ")).otherwise(F.col("l_quantity").cast("string"))
    second = F.when(F.col("l_linestatus") == "O", "C").otherwise(F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", keys.is_mixture(ratio, second).alias("mixture"))


@query("p12_label_fallback", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || '_' || (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) ELSE c_name END AS label FROM customer")
def p12(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("given", F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_name")))
    df = resolve.numbered(df, "c_mktsegment", ["c_custkey"])
    return df.select("c_custkey", keys.label_or(F.col("given"), F.col("c_mktsegment"), F.col("number")).alias("label"))


@query("p13_clip", "SELECT s_suppkey, least(greatest(s_acctbal, 0), 5000) AS clipped FROM supplier")
def p13(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", keys.clip(F.col("s_acctbal"), 0.0, 5000.0).alias("clipped"))


@query("p14_ratio_features", """SELECT l_orderkey AS entity, round(a / greatest(n, 1), 6) AS density, round(a * o / (n * n), 6) AS paired, k AS kinds FROM (
    SELECT l_orderkey, CAST(count(*) AS double) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_linestatus = 'O') AS o, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1)""")
def p14(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_distinct("l_returnflag").alias("kinds"))
    return g.select("entity", r(keys.guarded_ratio(F.col("a"), F.col("n"))).alias("density"), r(F.col("a") * F.col("o") / (F.col("n") * F.col("n"))).alias("paired"), "kinds")


# Resolution.

MEDIAN = f"""SELECT g.key, round(CASE WHEN n = 1 THEN f.value ELSE m END + 1e-9, 6) AS value, s AS source, f.name, f.priority FROM (
    SELECT key, count(*) AS n, coalesce(median(value) FILTER (source <> 'R'), median(value)) AS m, string_agg(DISTINCT source, '+' ORDER BY source) AS s FROM {M} WHERE value BETWEEN 905 AND 1900 GROUP BY key) g
    JOIN (SELECT key, value, name, priority FROM {M} WHERE value BETWEEN 905 AND 1900 QUALIFY row_number() OVER (PARTITION BY key ORDER BY {ROWS}) = 1) f ON f.key = g.key"""


@query("a01_resolve_conflicts", MEDIAN)
def a01(spark, sf_dir):
    df = resolve.in_range(meas(spark, sf_dir), 905, 1900)
    return resolve.resolve_conflicts(df, ORDER, "exclude", "R", meta=["name", "priority"]).withColumn("value", r(F.col("value") + 1e-9))


@query("a02_gold_dedup", f"""SELECT g.key, round(m + 1e-9, 6) AS value, f.name FROM (SELECT key, median(value) AS m FROM {M} WHERE source = 'A' GROUP BY key) g
    JOIN (SELECT key, name FROM {M} WHERE source = 'A' QUALIFY row_number() OVER (PARTITION BY key ORDER BY {ROWS}) = 1) f ON f.key = g.key""")
def a02(spark, sf_dir):
    gold = meas(spark, sf_dir).where("source = 'A'")
    return resolve.resolve_conflicts(gold, ORDER, meta=["name"]).select("key", r(F.col("value") + 1e-9).alias("value"), "name")


@query("a03_dedup_statistics", f"""SELECT CAST(sum(n) AS bigint) AS rows_before, count(*) AS rows_after, CAST(sum(n - 1) AS bigint) AS merged, count(*) FILTER (s > 10) AS wide, CAST(sum(f) AS bigint) AS no_canonical
    FROM (SELECT key, count(*) AS n, max(value) - min(value) AS s, count(*) FILTER (length(key) < 4) AS f FROM {M} GROUP BY key)""")
def a03(spark, sf_dir):
    return resolve.resolution_statistics(meas(spark, sf_dir), canonical=F.when(F.length("key") >= 4, F.col("key")))


@query("a04_describe", f"""SELECT source, count(value) AS n, round(min(value) + 1e-9, 4) AS low, round(max(value) + 1e-9, 4) AS high, round(avg(value) + 1e-9, 4) AS mean, round(median(value) + 1e-9, 4) AS median,
    round(stddev_pop(value) + 1e-9, 4) AS deviation, count(DISTINCT value) AS "distinct" FROM {M} GROUP BY source""")
def a04(spark, sf_dir):
    d = quality.describe(meas(spark, sf_dir), "value", ["source"])
    return d.select("source", "n", *(r(F.col(c) + 1e-9, 4).alias(c) for c in ("low", "high", "mean", "median", "deviation")), "distinct")


@query("a05_source_profile", f"""SELECT source, count(*) AS n, round(avg((value < 1500)::int), 6) AS parse_rate, count(*) FILTER (value < 950) AS low, count(*) FILTER (value > 1900) AS high,
    count(*) FILTER (length(key) < 5) AS short_keys, count(*) FILTER (o3 < 3) AS small, array_to_string(list_slice(list_sort(list(DISTINCT key) FILTER (value >= 1500)), 1, 5), ',') AS invalid FROM {M} GROUP BY source""")
def a05(spark, sf_dir):
    p = quality.source_profile(meas(spark, sf_dir), F.col("value") < 1500, F.col("o3"), low=950, high=1900)
    return p.select("source", "n", r(F.col("parse_rate")).alias("parse_rate"), "low", "high", "short_keys", "small", F.array_join("invalid_examples", ",").alias("invalid"))


@query("a06_value_counts", f"SELECT source, name, count(*) AS n FROM {M} GROUP BY source, name")
def a06(spark, sf_dir):
    return quality.value_counts(meas(spark, sf_dir), "source", "name")


@query("a07_cross_source_conflicts", f"""SELECT key, sources, round(span + 1e-9, 6) AS span, span > 30 AS over30, span > 50 AS over50 FROM (
    SELECT key, count(DISTINCT source) AS sources, max(value) - min(value) AS span FROM {M} GROUP BY key) WHERE sources > 1""")
def a07(spark, sf_dir):
    c = quality.cross_source_conflicts(meas(spark, sf_dir))
    return c.select("key", "sources", r(F.col("span") + 1e-9).alias("span"), (F.col("span") > 30).alias("over30"), (F.col("span") > 50).alias("over50"))


@query("a07_worst_conflicts", f"""SELECT key, round(span + 1e-9, 6) AS span FROM (SELECT key, count(DISTINCT source) AS s, max(value) - min(value) AS span FROM {M} GROUP BY key)
    WHERE s > 1 ORDER BY round(span + 1e-9, 6) DESC, key LIMIT 10""")
def a07_worst(spark, sf_dir):
    c = quality.cross_source_conflicts(meas(spark, sf_dir)).select("key", r(F.col("span") + 1e-9).alias("span"))
    return c.orderBy(F.desc("span"), "key").limit(10)


@query("a08_overlap_matrix", f"""WITH k AS (SELECT DISTINCT source, key FROM {D}), n AS (SELECT source, count(*) AS n FROM k GROUP BY source)
    SELECT x.source AS a, y.source AS b, count(*) AS shared, round(100 * count(*) / least(any_value(nx.n), any_value(ny.n)), 6) AS percent
    FROM k x JOIN k y ON x.key = y.key AND x.source < y.source JOIN n nx ON nx.source = x.source JOIN n ny ON ny.source = y.source GROUP BY x.source, y.source""")
def a08(spark, sf_dir):
    return quality.overlap_matrix(view(spark, sf_dir, DOCS)).withColumn("percent", r(F.col("percent")))


@query("a09_exclusive_keys", f"SELECT s AS source, count(*) AS exclusive FROM (SELECT key, min(source) AS s FROM {D} GROUP BY key HAVING count(DISTINCT source) = 1) GROUP BY s")
def a09(spark, sf_dir):
    return quality.exclusive_keys(view(spark, sf_dir, DOCS))


@query("a10_global_counts", f"SELECT count(DISTINCT key) AS keys, count(*) FILTER (value BETWEEN 1000 AND 1500) AS in_range FROM {M}")
def a10(spark, sf_dir):
    return quality.global_counts(meas(spark, sf_dir), 1000, 1500)


@query("a11_verify_output", f"""SELECT count(*) AS n, count(key) - count(DISTINCT key) AS repeated, round(min(value), 6) AS low, round(max(value), 6) AS high,
    count(*) FILTER (source <> 'A') AS train, count(*) FILTER (source = 'A') AS test, count(*) FILTER (value IS NULL) AS null_values FROM {M}""")
def a11(spark, sf_dir):
    df = meas(spark, sf_dir).select("key", "value", F.when(F.col("source") == "A", "test").otherwise("train").alias("split"))
    v = quality.verify_output(df, "key", "value", "split")
    return v.select("n", "repeated", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), "train", "test", F.col("nulls.value").alias("null_values"))


@query("j01_prefer_gold", f"SELECT key, value, source, name FROM {M} WHERE source <> 'A' AND key NOT IN (SELECT key FROM {M} WHERE source = 'A')")
def j01(spark, sf_dir):
    df = meas(spark, sf_dir)
    return resolve.prefer_gold(df.where("source = 'A'"), df.where("source <> 'A'")).select("key", "value", "source", "name")


@query("w01_first_rows", f"SELECT key, value, source, name FROM {M} QUALIFY row_number() OVER (PARTITION BY key ORDER BY {ROWS}) = 1")
def w01(spark, sf_dir):
    return resolve.first_rows(meas(spark, sf_dir), ORDER).select("key", "value", "source", "name")


@query("w06_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def w06(spark, sf_dir):
    from ..operators.metrics import top_k

    return top_k(table(spark, sf_dir, "part"), "p_retailprice", 20, "p_partkey").select("p_partkey", "p_retailprice")


@query("w10_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def w10(spark, sf_dir):
    return quality.head(table(spark, sf_dir, "orders"), 25, "o_orderkey").select("o_orderkey", "o_totalprice")


# Sets of keys.

@query("x01_union_sources", "SELECT origin, count(*) AS n FROM (SELECT 'train' AS origin FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'test' FROM orders WHERE o_orderkey % 5 = 0) GROUP BY origin")
def x01(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    both = o.where("o_orderkey % 5 <> 0").withColumn("origin", F.lit("train")).unionByName(o.where("o_orderkey % 5 = 0").withColumn("origin", F.lit("test")))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def _keys(spark, sf_dir, source: str) -> DataFrame:
    return meas(spark, sf_dir).where(F.col("source") == source).select("key")


@query("x02_intersection", f"SELECT key FROM {M} WHERE source = 'A' INTERSECT SELECT key FROM {M} WHERE source = 'N'")
def x02(spark, sf_dir):
    return _keys(spark, sf_dir, "A").intersect(_keys(spark, sf_dir, "N"))


@query("x03_difference", f"SELECT key FROM {M} WHERE source = 'N' EXCEPT SELECT key FROM {M} WHERE source = 'A'")
def x03(spark, sf_dir):
    return _keys(spark, sf_dir, "N").subtract(_keys(spark, sf_dir, "A"))


@query("x04_distinct_union", f"SELECT key FROM {M} WHERE source = 'R' UNION SELECT key FROM {M} WHERE source = 'A'")
def x04(spark, sf_dir):
    return _keys(spark, sf_dir, "R").union(_keys(spark, sf_dir, "A")).distinct()
