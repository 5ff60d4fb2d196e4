"""Survey-shaped views over the given tables (one DataFrame per survey entity).

Role map everywhere: line status ``O`` is the first survey (N), ``F`` the re-survey (Q).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resurvey.operators import regen

CELLS = ["m1c2", "m1c4", "m2c2", "m2c3", "m3c2", "m3c4", "m4c2", "m4c3"]
PAIRS = [("m1c2", "m1c4"), ("m2c2", "m2c3"), ("m3c2", "m3c4"), ("m4c2", "m4c3")]
MODULES = {"m1": PAIRS[0], "m2": PAIRS[1], "m3": PAIRS[2], "m4": PAIRS[3]}
EXOTIC_WORDS = ["hot", "cold", "new"]
PRIORITY_ITEMS = ["hot ring", "hot bolt", "cold gear", "new rod"]
SIZE_CLASSES = [
    "seed5_15",
    "seed15_30",
    "seed30_50",
    "seed50_137",
    "sap0_1",
    "sap1_25",
    "sap25_5",
    "sap5_10",
]
TARGET_TYPES = ["ECONOMY", "PROMO"]


class Views:
    """Lazily built views; every method returns a fresh DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _role(self):
        return F.when(F.col("l_linestatus") == "O", "N").otherwise("Q")

    def _flag(self):
        """The one-letter return flag as a number, so that its minimum is a hash aggregate."""
        return F.ascii("l_returnflag")

    def _with_parts(self, part: DataFrame) -> DataFrame:
        """Line items with columns of their parts, merged by a shuffle of both: parts grow with the line items.

        Spark would judge by the compressed bytes of their files whether to broadcast them, and the driver then
        holds one hash table of every part for each choice of columns, more than fifty times what Spark expects.
        """
        return self.table("lineitem").join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))

    def rating(self) -> DataFrame:
        """unit x role: one category code and a confidence class."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("unit"), self._role().alias("role"))
            .agg(
                F.char(F.min(self._flag())).alias("value"),
                F.min(F.when(F.col("l_linenumber") == 1, 1).otherwise(2)).alias("fit"),
            )
        )

    def pair(self) -> DataFrame:
        """unit: both ratings and both confidence classes side by side."""
        n, q = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
        fit = F.when(F.col("l_linenumber") == 1, 1).otherwise(2)
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("unit"))
            .agg(
                F.char(F.min(F.when(n, self._flag()))).alias("value1"),
                F.char(F.min(F.when(q, self._flag()))).alias("value2"),
                F.min(F.when(n, fit)).alias("fit1"),
                F.min(F.when(q, fit)).alias("fit2"),
            )
        )

    def tree(self) -> DataFrame:
        """tree x role with the id of the same tree in the other survey."""
        key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        cents = F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 100).cast("long"))
        t = (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber", self._role().alias("role"))
            .agg(
                F.max("l_quantity").alias("dbh"),
                (F.min("l_quantity").cast("long") % 5).alias("status"),
                (1 + F.max(cents) % 5).alias("crown"),
                F.char(F.min(self._flag())).alias("code1"),
                F.char(F.when(F.min(self._flag()) != F.max(self._flag()), F.max(self._flag()))).alias("code2"),
                (1 + F.max("l_quantity").cast("long") % 5).alias("level1"),
                (F.max("l_suppkey") % 7).alias("rater"),
            )
        )
        other = F.when(F.col("role") == "N", "Q").otherwise("N")
        return t.select(
            F.concat_ws("-", key, F.col("role")).alias("id"),
            F.concat_ws("-", key, other).alias("link_id"),
            "role", "status", "dbh", "crown", "code1", "code2", "level1", "rater",
        )

    def spec(self) -> DataFrame:
        """plot-year x role x item with a cover class and eight presence cells."""
        part = self.table("part").select("p_partkey", "p_name")
        hits = {c: F.col("l_partkey") % 8 == i for i, c in enumerate(CELLS)}

        def cell(c: str):
            n = F.count(F.when(hits[c], 1))
            return F.when(n > 0, F.least(n, F.lit(3).cast("long"))).cast("long").alias(c)

        sup = F.col("l_suppkey")
        park = F.concat(F.lit("PK"), F.lpad((sup % 20).cast("string"), 2, "0"))
        sup3 = F.when(F.length(sup.cast("string")) >= 3, sup.cast("string")).otherwise(
            F.lpad(sup.cast("string"), 3, "0")
        )
        word = F.substring_index("item", " ", 1)
        return (
            self.table("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(
                sup.alias("supp"),
                F.year("l_shipdate").cast("long").alias("year"),
                self._role().alias("role"),
                F.col("p_name").alias("item"),
            )
            .agg(
                (1 + F.floor((F.max("l_quantity") - 1) / 5)).cast("long").alias("cover_class"),
                *[cell(c) for c in CELLS],
            )
            .withColumn("l_suppkey", F.col("supp"))
            .withColumn("park", park)
            .withColumn("plot", F.concat("park", sup3))
            .withColumn("unit", F.concat_ws("_", "plot", F.col("year").cast("string")))
            .withColumn("exotic", word.isin(EXOTIC_WORDS))
            .withColumn("priority", F.col("item").isin(PRIORITY_ITEMS))
            .withColumn("longitude", -80 - (F.col("supp") % 10) / 10)
            .withColumn("latitude", 30 + (F.col("supp") % 100) / 10)
            .select(
                "unit", "plot", "park", "supp", "year", "role", "item", "cover_class", *CELLS,
                "exotic", "priority", "longitude", "latitude",
            )
        )

    def count(self) -> DataFrame:
        """unit x role x module: record count and mean quantity."""
        return (
            self.records()
            .groupBy("unit", "role", "module")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("avg_val"))
        )

    def records(self) -> DataFrame:
        """the raw records behind ``count``: unit, role, module, qty."""
        return self.table("lineitem").select(
            F.concat_ws("_", F.col("l_suppkey").cast("string"), F.year("l_shipdate").cast("string")).alias("unit"),
            self._role().alias("role"),
            (1 + F.col("l_linenumber") % 4).cast("long").alias("module"),
            F.col("l_quantity").alias("qty"),
        )

    def thr(self) -> DataFrame:
        """plot event with one measure: unit, subunit, bin, period, y."""
        cust = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        nation = self.table("nation")
        region = self.table("region")
        return (
            self.table("orders")
            .select("o_custkey", "o_orderdate", "o_totalprice")
            .join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("r_name").alias("unit"),
                F.col("n_name").alias("subunit"),
                F.col("c_mktsegment").alias("bin"),
                F.year("o_orderdate").cast("long").alias("period"),
                F.col("o_totalprice").alias("y"),
            )
        )

    def surveys(self) -> DataFrame:
        """unit, survey date and cycle (week number) of every first survey."""
        day = F.to_date("ts")
        return (
            self.table("events")
            .where(F.col("event_type") == "view")
            .select(
                F.col("user_id").alias("unit"),
                F.lit("N").alias("role"),
                day.alias("survey_date"),
                (1 + F.floor(F.datediff(day, F.lit("2024-01-01").cast("date")) / 7)).cast("long").alias("cycle_no"),
            )
            .distinct()
        )

    def burns(self) -> DataFrame:
        """unit and date of every prior event (disturbance)."""
        return (
            self.table("events")
            .where(F.col("event_type") == "error")
            .select(F.col("user_id").alias("unit"), F.to_date("ts").alias("event_date"))
            .distinct()
        )

    def _regen_base(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_type", "p_size")
        supp = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation")
        region = self.table("region")
        year = F.year("l_shipdate").cast("long")
        return (
            self.table("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat_ws("-", F.col("l_suppkey").cast("string"), year.cast("string")).alias("event"),
                F.col("n_name").alias("area"),
                F.col("r_name").alias("zone"),
                F.concat(F.lit("G"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("community"),
                F.col("l_suppkey").cast("string").alias("plot"),
                year.alias("year"),
                F.ceil((year - 1994) / 5).cast("long").alias("cycle_no"),
                self._role().alias("role"),
                F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("corner"),
                (1 + F.col("l_linenumber") % 4).cast("long").alias("module"),
                F.col("p_type").isin(TARGET_TYPES).alias("target"),
                F.floor((F.col("p_size") - 1) * 8 / 50).cast("long").alias("class_no"),
                F.col("p_size").cast("double").alias("dbh"),
                (F.col("l_quantity").cast("long") % 5).alias("status"),
                F.col("l_quantity").cast("long").alias("cnt"),
            )
        )

    def regen(self) -> DataFrame:
        """event x role x corner x target: counts in eight size classes.

        Counted on the numeric keys first; the names of the place are joined to the counts.
        """
        part = self.table("part").select(
            "p_partkey",
            F.col("p_type").isin(TARGET_TYPES).alias("target"),
            F.floor((F.col("p_size") - 1) * 8 / 50).cast("long").alias("class_no"),
        )
        cnt = F.col("l_quantity").cast("long")
        counted = (
            self._with_parts(part)
            .groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("year"), "l_linestatus", "l_linenumber", "target")
            .agg(
                *[
                    F.coalesce(F.sum(F.when(F.col("class_no") == i, cnt)), F.lit(0)).alias(c)
                    for i, c in enumerate(SIZE_CLASSES)
                ]
            )
        )
        return self._placed(counted, "zone", "community").select(
            "event", "area", "zone", "community", "plot", "year", "cycle_no",
            self._role().alias("role"),
            F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("corner"),
            (1 + F.col("l_linenumber") % 4).cast("long").alias("module"),
            "target",
            *SIZE_CLASSES,
        )

    def _placed(self, counted: DataFrame, *more: str) -> DataFrame:
        """Counts by l_suppkey and year with the names of their event and place."""
        supp = self.table("supplier").select("s_suppkey", "s_nationkey")
        place = (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("area"), F.col("r_name").alias("zone"))
        )
        joined = counted.join(supp.hint("merge"), F.col("l_suppkey") == F.col("s_suppkey")).join(place, F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.withColumns(
            {
                "event": F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("year").cast("string")),
                "community": F.concat(F.lit("G"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")),
                "plot": F.col("l_suppkey").cast("string"),
                "cycle_no": F.ceil((F.col("year") - 1994) / 5).cast("long"),
            }
        )

    def regen_stems(self) -> DataFrame:
        """The rows of ``regen_tree`` on numeric keys: l_suppkey, year, role, module, target, dbh, status."""
        part = self.table("part").select("p_partkey", F.col("p_type").isin(TARGET_TYPES).alias("target"), F.col("p_size").cast("double").alias("dbh"))
        return self._with_parts(part).select(
            "l_suppkey", F.year("l_shipdate").cast("long").alias("year"), self._role().alias("role"),
            (1 + F.col("l_linenumber") % 4).cast("long").alias("module"), "target", "dbh", (F.col("l_quantity").cast("long") % 5).alias("status"),
        )

    def stem_counts(self, keys: list[str], lo: float | None, hi: float | None, **kw) -> DataFrame:
        """F13 counted on the numeric keys; ``keys`` are the event columns that the counts then get."""
        own = ["l_suppkey", "year", *[k for k in keys if k == "role"]]
        counts = regen.module_tree_counts(self.regen_stems(), own, lo, hi, [1, 2, 3, 4], **kw)
        return self._placed(counts).select(*keys, "target", "module", "trees")

    def regen_tree(self) -> DataFrame:
        """one row per measured tree: diameter, status, module, target flag."""
        return self._regen_base().select(
            "event", "area", "zone", "plot", "year", "cycle_no", "role", "module", "target", "dbh", "status"
        )

    def bound(self) -> DataFrame:
        """boundary vertices: unit, x, y, piece."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("unit"),
            F.col("l_extendedprice").alias("x"),
            F.col("l_quantity").alias("y"),
            F.col("l_linenumber").cast("long").alias("piece"),
        )
