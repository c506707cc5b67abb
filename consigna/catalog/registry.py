"""Query registry and the views all queries start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consigna.functions.text import WS

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Key of a line. Order and line number alone are not unique, nor are they with part and supplier.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_cents"]

#: Suppliers up to which they are broadcast, at about 100 bytes each.
FEW_SUPPLIERS = 500_000


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def padded(c: Column, width: int = 12) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def order_code(key: Column) -> Column:
    return F.concat(F.lit("ORD-"), padded(key))


def sku_code(key: Column) -> Column:
    return F.concat(F.lit("SKU"), padded(key))


class Tables:
    """The supplied tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """The same rows on all cores, when the files have fewer splits than there are cores.

        A file with one row group is one task otherwise. Large tables have many splits and stay as
        they are.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def lines(self) -> DataFrame:
        return self.read("lineitem").withColumn("l_cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))

    def records(self, together: bool = False) -> DataFrame:
        """Order lines as imported records.

        Orders meet their customers, and suppliers their nations, before the lines: lines are never shuffled for a
        customer. Up to FEW_SUPPLIERS suppliers are broadcast, so lines are not shuffled for them either; more are met
        last, behind the shuffle for a part. `together`: lines meet orders last of those that shuffle them, so that the lines of
        an order leave from one task, and what merges them there needs one copy of what they share.
        """
        buyers = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        supply = self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        few = supply.count() <= FEW_SUPPLIERS
        orders, parts = (buyers, F.col("l_orderkey") == F.col("o_orderkey")), (self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        supplied = (F.broadcast(supply) if few else supply, F.col("l_suppkey") == F.col("s_suppkey"))
        meets = [parts, orders] if together else [orders, parts]
        lines = self.spread(self.lines())
        for other, on in [*meets, supplied] if few or not together else [supplied, *meets]:
            lines = lines.join(other, on)
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        return lines.select(
            *LINE,
            order_code(F.col("l_orderkey")).alias("externalCode"),
            F.when(part % 11 == 0, "").otherwise(F.col("c_name")).alias("storeName"),
            F.when(supp % 3 == 0, " ").otherwise(F.col("s_name")).alias("receiverName"),
            F.when(supp % 7 == 0, "12345").otherwise(F.concat(F.lit("13"), padded(supp, 9))).alias("receiverPhone"),
            F.when(supp % 5 == 0, "").otherwise(F.col("n_name")).alias("receiverAddress"),
            sku_code(part).alias("skuCode"),
            F.concat(F.lit(" "), F.col("p_name")).alias("skuName"),
            F.when(F.col("l_linenumber") == 7, "n/a")
            .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("skuQuantity"),
            F.col("p_type").alias("skuSpec"),
            F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("remark"),
            F.concat(F.lit("B"), F.floor(F.col("l_orderkey") / 1000).cast("string")).alias("batch_id"),
        )

    def sheets(self) -> DataFrame:
        """Documents as sheets, eight to a file."""
        return self.spread(self.read("documents")).select(
            F.concat(F.lit("book-"), F.floor(F.col("doc_id") / 8).cast("string")).alias("file_id"),
            (F.col("doc_id") % 8).cast("int").alias("sheet_idx"),
            F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("sheet_name"),
            "text",
        )

    def rows(self) -> DataFrame:
        """Document lines as sheet rows, words as cells."""
        return (
            self.sheets()
            .select("file_id", "sheet_idx", "sheet_name", F.posexplode(F.split("text", "\n", -1)).alias("row_idx", "line"))
            .select("file_id", "sheet_idx", "sheet_name", "row_idx", F.split("line", " ", -1).alias("cells"))
        )

    def single_sheets(self) -> DataFrame:
        """Document lines as sheet rows, one file for each document."""
        return self.rows().withColumns({
            "file_id": F.concat_ws("/", "file_id", F.col("sheet_idx").cast("string")), "sheet_idx": F.lit(0)})

    def texts(self) -> DataFrame:
        """Documents as texts."""
        return self.spread(self.read("documents")).select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"), "text")

    def orders(self, given: DataFrame | None = None, *more: Column) -> DataFrame:
        """Orders as the stored order table; `more` are further columns of the given orders."""
        o = self.read("orders") if given is None else given
        key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        return o.select(
            F.concat(F.lit("O-"), key.cast("string")).alias("id"),
            order_code(key).alias("external_code"),
            F.concat(F.lit("Store "), cust).alias("store_name"),
            F.concat(F.lit("Receiver "), cust).alias("receiver_name"),
            F.concat(F.lit("13"), padded(F.col("o_custkey"), 9)).alias("receiver_phone"),
            F.concat(F.lit("Street "), cust).alias("receiver_address"),
            F.col("o_orderpriority").alias("remark"),
            F.concat(F.lit("B"), F.floor(key / 1000).cast("string")).alias("batch_id"),
            F.col("o_orderdate").alias("created_at"),
            *more,
        )

    def items(self, lines: DataFrame | None = None, *more: Column) -> DataFrame:
        """Order lines as the stored item table; `more` are further columns of the given lines."""
        return (self.spread(self.lines()) if lines is None else lines).select(
            F.concat_ws("-", F.lit("I"), *[F.col(c).cast("string") for c in LINE]).alias("id"),
            F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("order_id"),
            sku_code(F.col("l_partkey")).alias("sku_code"),
            F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("sku_name"),
            F.col("l_quantity").cast("decimal(38,18)").alias("sku_quantity"),
            F.col("l_returnflag").alias("sku_spec"),
            *more,
        )


def sql_trim(x: str) -> str:
    return f"trim({x}, '{WS}')"


def sql_blank(x: str) -> str:
    return f"(coalesce({sql_trim(x)}, '') = '')"


def _pad(x: str, width: int = 12) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {width}, '0')"


def sql_code(x: str) -> str:
    return f"concat('ORD-', {_pad(x)})"


def sql_sku(x: str) -> str:
    return f"concat('SKU', {_pad(x)})"


LINES = "lines AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents FROM lineitem)"

RECORDS = LINES + f""",
rec AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_cents, {sql_code('l_orderkey')} AS externalCode,
    CASE WHEN l_partkey % 11 = 0 THEN '' ELSE c_name END AS storeName,
    CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS receiverName,
    CASE WHEN l_suppkey % 7 = 0 THEN '12345' ELSE concat('13', {_pad('l_suppkey', 9)}) END AS receiverPhone,
    CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE n_name END AS receiverAddress,
    {sql_sku('l_partkey')} AS skuCode, concat(' ', p_name) AS skuName,
    CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS skuQuantity,
    p_type AS skuSpec, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS remark,
    concat('B', CAST(l_orderkey // 1000 AS VARCHAR)) AS batch_id
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey)"""

SHEETS = """sheets AS (
  SELECT concat('book-', CAST(doc_id // 8 AS VARCHAR)) AS file_id, CAST(doc_id % 8 AS INT) AS sheet_idx,
    concat(lang, '-', CAST(doc_id AS VARCHAR)) AS sheet_name, text FROM documents)"""

ROWS = SHEETS + """, raw AS (
  SELECT file_id, sheet_idx, sheet_name, CAST(i - 1 AS INT) AS row_idx, string_split(line, ' ') AS cells, line
  FROM (SELECT file_id, sheet_idx, sheet_name, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sheets))"""

TEXTS = "texts AS (SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS file_id, text FROM documents)"

ORDERS = f"""store_orders AS (
  SELECT concat('O-', CAST(o_orderkey AS VARCHAR)) AS id, {sql_code('o_orderkey')} AS external_code,
    concat('Store ', CAST(o_custkey AS VARCHAR)) AS store_name, concat('Receiver ', CAST(o_custkey AS VARCHAR)) AS receiver_name,
    concat('13', {_pad('o_custkey', 9)}) AS receiver_phone, concat('Street ', CAST(o_custkey AS VARCHAR)) AS receiver_address,
    o_orderpriority AS remark, concat('B', CAST(o_orderkey // 1000 AS VARCHAR)) AS batch_id, o_orderdate AS created_at
  FROM orders)"""

ITEMS = LINES + f""",
store_items AS (
  SELECT concat_ws('-', 'I', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
      CAST(l_suppkey AS VARCHAR), CAST(l_cents AS VARCHAR)) AS id, concat('O-', CAST(l_orderkey AS VARCHAR)) AS order_id, {sql_sku('l_partkey')} AS sku_code,
    concat('Part ', CAST(l_partkey AS VARCHAR)) AS sku_name, l_quantity AS sku_quantity, l_returnflag AS sku_spec
  FROM lines)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
