"""The tables that stand for measurements, materials, features and so on, in SQL that Spark and DuckDB read alike.

``{name}`` stands for an input table; in Spark it is a DataFrame, in DuckDB the table's name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MEAS = """SELECT concat(l_partkey, '-', l_linenumber) AS key, l_extendedprice / l_quantity AS value, l_returnflag AS source,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS priority, l_orderkey AS o1, l_suppkey AS o2, l_quantity AS o3,
    l_extendedprice AS o4, l_discount + 0e0 AS o5, l_tax + 0e0 AS o6, l_linestatus AS name FROM {lineitem}"""
ORDER = ["priority", "o1", "o2", "o3", "o4", "o5", "o6", "name"]

DOCS = r"""SELECT doc_id, lower(trim(regexp_replace(text, '[ \t-\r]+', ' '@g))) AS key, source, lang FROM {documents}"""

FEAT = """SELECT p_partkey AS id, CAST(p_size AS double) AS x1, p_retailprice AS x2, q AS x3, d AS x4,
    300 + 2 * CAST(p_size AS double) + 5e-2 * p_retailprice + 3 * q + (p_partkey * 7919 % 101) / 1e1 AS y
    FROM {part} LEFT JOIN (SELECT l_partkey, round(avg(l_quantity) + 1e-9, 6) AS q, round(avg(l_discount + 0e0) + 1e-9, 6) AS d FROM {lineitem} GROUP BY l_partkey)
    ON l_partkey = p_partkey"""
FEATURES = ["x1", "x2", "x3", "x4"]

PRED = f"""SELECT id, y, CAST(id % 5 AS int) AS fold, model, CASE model WHEN 'a' THEN y + (id * 31) % 21 - 10 ELSE y + (id * 17) % 41 - 20 END AS yhat
    FROM ({FEAT}) CROSS JOIN (SELECT 'a' AS model UNION ALL SELECT 'b' AS model) WHERE y IS NOT NULL"""

MAT = "SELECT s_suppkey AS k, 300 + s_acctbal / 1e2 AS t, s_acctbal AS raw FROM {supplier}"

STATES = "SELECT l_orderkey AS entity, 10 * (l_discount + 0e0) + l_tax AS energy FROM {lineitem}"

COORDS = """SELECT l_orderkey AS entity, CAST(l_returnflag = 'A' AS int) AS conf, l_quantity AS x, 100 * (l_discount + 0e0) AS y, 100 * (l_tax + 0e0) AS z,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'A' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pos FROM {lineitem}"""

COUNTS = "SELECT l_orderkey AS entity, concat(l_returnflag, l_linestatus) AS grp, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, concat(l_returnflag, l_linestatus)"

PROPS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 11 = 0 THEN concat('{{', c_name, '}}|Tg=1;tg=', c_acctbal, 'K;bad|')
    ELSE concat('{{', c_name, '}}|Tg=', c_acctbal, 'K;Source=', c_mktsegment, '|') END AS text, c_name, c_acctbal, c_mktsegment FROM {customer}"""

SEQS = "SELECT o_orderkey AS id, translate(CAST(o_orderkey * 7919 AS varchar(30)), '0123456789', 'ACGTACGTAN') AS seq FROM {orders}"


def tables_of(sql: str) -> set[str]:
    return set(re.findall(r"(?<!\{)\{(\w+)\}", sql))


#: Rows of one task where a view's table is dealt by a key.
DEALT = 250_000


def view(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``. Tables in ``dealt`` are dealt by a column into as many tasks as their rows
    need, so that windows and groups within its values sort rows of one task only, and need no further shuffle."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)}
    for t, key in (dealt or {}).items():
        used[t] = used[t].repartition(max(spark.sparkContext.defaultParallelism, -(-used[t].count() // DEALT)), key)
    return spark.sql(sql.replace("@g", ""), **used)


def duck(sql: str) -> str:
    """The same view for DuckDB, as a subquery's text."""
    return re.sub(r"(?<!\{)\{(\w+)\}", r"\1", sql).replace("@g", ", 'g'").replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
