"""Learning tables derived from an order book, so every job can run on relational test data.

Customers are learners, order priority and year form the course, order lines are click and score
records, parts are assessments, suppliers are enrolled learners who never show any activity. Every
table is read whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.operators.features import Inputs
from coursebeacon.session import staged

SUPPLIER_OFFSET = 1_000_000_000


# Only the columns used; with the schema given, reading starts no job to infer it.
TABLES = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, "
                "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_size INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder.rstrip('/')}/{table}.parquet")


def _order_course(orders: DataFrame) -> DataFrame:
    module = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        "o_orderkey", F.col("o_custkey").alias("id_student"), module.alias("code_module"),
        F.year("o_orderdate").cast("string").alias("code_presentation"),
        "o_orderstatus", "o_totalprice",
    )


def student_info(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of a customer in a course decides the result."""
    ok = ((F.col("o_orderstatus") == "F") & (F.col("id_student") % 4 != 0)) | (
        (F.col("o_orderstatus") == "O") & (F.col("id_student") % 4 == 3)
    )
    code = (
        F.when((F.col("o_totalprice") >= 400000) & ok, 0).when(ok, 1)
        .when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    )
    # min_by over fixed-width values combines on the map side; a window would sort every group
    first = (
        _order_course(_read(spark, folder, "orders"))
        .groupBy("id_student", "code_module", "code_presentation")
        .agg(F.min_by(code, "o_orderkey").alias("code"))
    )
    names = F.array(*[F.lit(n) for n in ("Distinction", "Pass", "Withdrawn", "Fail")])
    customers = first.select("id_student", "code_module", "code_presentation",
                             names[F.col("code")].alias("final_result"))
    suppliers = _read(spark, folder, "supplier").select(
        (F.col("s_suppkey") + SUPPLIER_OFFSET).cast("bigint").alias("id_student"),
        (1 + F.col("s_nationkey") % 5).cast("string").alias("code_module"),
        F.lit("2000").alias("code_presentation"), F.lit("Withdrawn").alias("final_result"),
    )
    return customers.unionByName(suppliers)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line as a click and a score of the learner who ordered: what both logs are cut from."""
    orders = _order_course(_read(spark, folder, "orders")).drop("o_orderstatus", "o_totalprice")
    lines = _read(spark, folder, "lineitem")
    offset = 3 * F.col("code_module").cast("int")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "id_student", "code_module", "code_presentation", "l_partkey",
        ((F.dayofyear("l_shipdate") - 1) % 210 - 25 + offset).alias("date"),
        (F.col("l_quantity").cast("bigint") * (1 + F.col("id_student") % 4)).alias("sum_click"),
        F.when(F.col("l_returnflag") != "R", F.round(F.col("l_discount") * 1000)).alias("score"),
    )


def written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``order_lines``, joined and written once, rows of a learner side by side.

    Sums by learner then hold a learner in few tasks, so that little is left to shuffle. The rebalance splits a
    learner with very many rows over several files.
    """
    return staged(order_lines(spark, folder).hint("rebalance", "id_student"), "order-lines")


def student_vle(lines: DataFrame) -> DataFrame:
    return lines.select("id_student", "code_module", "code_presentation", F.col("l_partkey").alias("id_site"),
                        "date", "sum_click")


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """Six presentations against seven in the orders: one year has no assessments."""
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("id_assessment"),
        (1 + F.col("p_partkey") % 5).cast("string").alias("code_module"),
        (1995 + F.col("p_partkey") % 6).cast("string").alias("code_presentation"),
        F.lit(None).cast("int").alias("date"), F.col("p_size").cast("double").alias("weight"),
    )


def student_assessment(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_partkey").alias("id_assessment"), "id_student", "score")


def inputs(spark: SparkSession, folder: str) -> Inputs:
    """The four tables; click log and scores are read from ``written_lines``, as often as a job needs them."""
    lines = written_lines(spark, folder)
    return Inputs(
        student_info(spark, folder), student_vle(lines),
        assessments(spark, folder), student_assessment(lines),
    )
