"""The query register and the frames the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.session import spread, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under `name`; `covers` lists the inventory ids it exercises."""

    def add(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        QUERIES[name] = run
        COVERS[name] = covers.split()
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


#: Tables whose rows are expensive to work on: long texts and vectors.
HEAVY = ("documents", "conversations", "pages", "embeddings")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def transactions(spark: SparkSession, sf: str, part: bool = False) -> DataFrame:
    """Card-like transactions: one row per order line."""
    lines = spread(table(spark, sf, "lineitem"))
    orders = table(spark, sf, "orders")
    out = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if part:
        p = table(spark, sf, "part")
        out = out.join(p, out.l_partkey == p.p_partkey)
    cols = {
        "user_id": "o_custkey",
        "order_id": "l_orderkey",
        "line": "l_linenumber",
        "merchant": "l_suppkey",
        "channel": "l_returnflag",
        "status": "l_linestatus",
        "amount": "l_extendedprice",
        "quantity": "l_quantity",
        "discount": "l_discount",
    }
    keep = [F.col(v).alias(k) for k, v in cols.items()]
    keep.append(F.to_date("l_shipdate").alias("day"))
    keep.append(F.col("l_partkey").alias("item"))
    if part:
        keep += [F.col("p_size").alias("mcc"), F.col("p_brand").alias("brand")]
    return out.select(*keep)


#: The same frames as SQL, for the expected results.
TXN = """txn AS (SELECT o_custkey AS user_id, l_orderkey AS order_id, l_linenumber AS line,
  l_suppkey AS merchant, l_returnflag AS channel, l_linestatus AS status, l_extendedprice AS amount,
  l_quantity AS quantity, l_discount AS discount, CAST(l_shipdate AS DATE) AS day, l_partkey AS item,
  p_size AS mcc, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def unit(expr: str) -> str:
    """SQL for the deterministic draw in [0, 1) that `functions.stats.md5_unit` makes."""
    return f"(('0x' || substr(md5(({expr})::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: A prediction log: one row per event with two model scores, their blend and an outcome.
PRED = f"""pred AS (SELECT event_id AS id, user_id, 't' || (user_id % 3) AS task, 'v' || (event_id % 2 + 1) AS version, ts,
  floor({unit("event_id || ':a'")} * 100) / 100 AS s1, floor((0.8 * {unit("event_id || ':a'")} + 0.2 * {unit("event_id || ':b'")}) * 1000) / 1000 AS s2,
  CASE WHEN {unit("event_id || ':y'")} < {unit("event_id || ':a'")} THEN 1 ELSE 0 END AS y, value FROM events)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.functions.stats import md5_unit

    def draw(tag: str):
        return md5_unit(F.concat(F.col("event_id").cast("string"), F.lit(f":{tag}")))

    a, b = draw("a"), draw("b")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("task"),
        F.concat(F.lit("v"), (F.col("event_id") % 2 + 1).cast("string")).alias("version"),
        "ts",
        (F.floor(a * 100) / 100).alias("s1"),
        (F.floor((0.8 * a + 0.2 * b) * 1000) / 1000).alias("s2"),
        (draw("y") < a).cast("int").alias("y"),
        "value",
    )
