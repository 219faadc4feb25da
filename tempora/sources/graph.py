"""The evidence graph as views over the raw tables: pure projections and aggregations, nothing is cached.

Every assertion row has: id, subject, predicate, obj_kind, obj_entity, obj_text,
valid_from, valid_to, tx_from, tx_to, pct, confidence, source_ids, context, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSERTION = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("predicate", T.StringType()), T.StructField("obj_kind", T.StringType()), T.StructField("obj_entity", T.StringType()), T.StructField("obj_text", T.StringType()),
        T.StructField("valid_from", T.LongType()), T.StructField("valid_to", T.LongType()), T.StructField("tx_from", T.LongType()), T.StructField("tx_to", T.LongType()), T.StructField("pct", T.LongType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("source_ids", T.ArrayType(T.StringType())), T.StructField("context", T.StringType()), T.StructField("status", T.StringType()),
    ]
)
_LONG, _TEXT = "bigint", "string"


class Graph:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _assertions(self, df: DataFrame, id: Column, subject: Column, predicate: str, entity: Column | None, text: Column | None, valid_from: Column, valid_to: Column | None, tx_from: Column, pct: Column, tx_to=None, context=None, status=None) -> DataFrame:
        null = lambda t: F.lit(None).cast(t)
        pick = lambda c, t: null(t) if c is None else c.cast(t)
        n = self.raw("documents").count()  # from the files' footers
        tx = tx_from.cast(_LONG)
        return df.select(
            id.cast(_TEXT).alias("id"), subject.cast(_TEXT).alias("subject"), F.lit(predicate).alias("predicate"), F.lit("Text" if entity is None else "Entity").alias("obj_kind"), pick(entity, _TEXT).alias("obj_entity"), pick(text, _TEXT).alias("obj_text"),
            valid_from.cast(_LONG).alias("valid_from"), pick(valid_to, _LONG).alias("valid_to"), tx.alias("tx_from"), pick(tx_to, _LONG).alias("tx_to"), pct.cast(_LONG).alias("pct"), (pct.cast("double") / 100).alias("confidence"),
            F.array(F.concat(F.lit("source-"), (tx % max(1, n)).cast(_TEXT))).alias("source_ids"), pick(context, _TEXT).alias("context"), (F.lit("Active") if status is None else status).alias("status"),
        )

    @staticmethod
    def _key(kind: str, c: str) -> Column:
        return F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))

    @staticmethod
    def _day(c: str) -> Column:
        return F.date_format(c, "yyyyMMdd").cast(_LONG)

    def state(self) -> DataFrame:
        """What events say of users' states, in epoch seconds; a tenth are retracted, a fifth open-ended."""
        e, i = self.raw("events"), F.col("event_id")
        start = F.unix_seconds(F.col("ts").cast("timestamp"))
        end = F.when(i % 5 != 0, start + 3600 * (1 + i % 24))
        context = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("tenant:"), (F.col("user_id") % 3).cast(_TEXT)))
        return self._assertions(e, self._key("state", "event_id"), self._key("user", "user_id"), "STATE", None, F.col("event_type"), start, end, i, 50 + i % 50, F.when(i % 10 == 0, i + 500), context, F.when(i % 10 == 0, "Retracted").otherwise("Active"))

    def located(self) -> DataFrame:
        """Customers and suppliers in nations, nations in regions."""
        since, pct = F.lit(19950101), F.lit(90)
        c = self._assertions(self.raw("customer"), self._key("loc-customer", "c_custkey"), self._key("customer", "c_custkey"), "LOCATED_IN", self._key("nation", "c_nationkey"), None, since, None, F.col("c_custkey"), pct)
        s = self._assertions(self.raw("supplier"), self._key("loc-supplier", "s_suppkey"), self._key("supplier", "s_suppkey"), "LOCATED_IN", self._key("nation", "s_nationkey"), None, since, None, F.col("s_suppkey"), pct)
        n = self._assertions(self.raw("nation"), self._key("loc-nation", "n_nationkey"), self._key("nation", "n_nationkey"), "LOCATED_IN", self._key("region", "n_regionkey"), None, since, None, F.col("n_nationkey"), pct)
        return c.union(s).union(n)

    def placed(self) -> DataFrame:
        """Orders of customers, by day."""
        digit = F.substring("o_orderpriority", 1, 1).cast("int")
        return self._assertions(self.raw("orders"), self._key("placed", "o_orderkey"), self._key("customer", "o_custkey"), "PLACED", self._key("order", "o_orderkey"), None, self._day("o_orderdate"), None, F.col("o_orderkey"), 95 - 5 * F.coalesce(digit, F.lit(0)))

    def supplied(self) -> DataFrame:
        """Which suppliers delivered a part, from the first to the last shipping day."""
        day = self._day("l_shipdate")
        g = self.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(day).alias("a"), F.max(day).alias("b"), F.min("l_orderkey").alias("tx"), F.count("*").alias("n"))
        return self._assertions(g, F.concat_ws("-", F.lit("supplied"), "l_partkey", "l_suppkey"), self._key("part", "l_partkey"), "SUPPLIED_BY", self._key("supplier", "l_suppkey"), None, F.col("a"), F.when(F.col("b") > F.col("a"), F.col("b")), F.col("tx"), 60 + F.least(F.col("n"), F.lit(39)))

    def assertions(self) -> DataFrame:
        return self.state().union(self.located()).union(self.placed()).union(self.supplied())

    def entities(self) -> DataFrame:
        """(id, entity_type, canonical_name, created_tx)"""

        def one(table, kind, key, name, type_):
            return self.raw(table).select(self._key(kind, key).alias("id"), F.lit(type_).alias("entity_type"), F.col(name).cast(_TEXT).alias("canonical_name") if name else F.lit(None).cast(_TEXT).alias("canonical_name"), F.col(key).cast(_LONG).alias("created_tx"))

        parts = [one("customer", "customer", "c_custkey", "c_name", "Person"), one("supplier", "supplier", "s_suppkey", "s_name", "Organization"), one("nation", "nation", "n_nationkey", "n_name", "Place"), one("region", "region", "r_regionkey", "r_name", "Place"), one("part", "part", "p_partkey", "p_name", "Custom(Part)"), one("orders", "order", "o_orderkey", None, "Event")]
        users = self.raw("events").select("user_id").filter("user_id is not null").distinct()
        parts.append(users.select(self._key("user", "user_id").alias("id"), F.lit("Person").alias("entity_type"), F.lit(None).cast(_TEXT).alias("canonical_name"), F.col("user_id").cast(_LONG).alias("created_tx")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def sources(self) -> DataFrame:
        """(id, source_type, uri, content_hash, observed_at, trust_pct, trust_score)"""
        kinds = F.array(*[F.lit(k) for k in ("Document", "WebPage", "DatabaseRecord", "ApiResponse", "HumanReport", "SensorReading")])
        pct = F.when(F.col("quality") == 1, 90).when(F.col("quality") == 0, 40)
        d = self.raw("documents").select("doc_id", "source", "text").join(self.raw("labels").select("doc_id", "quality"), "doc_id", "left")
        return d.select(self._key("source", "doc_id").alias("id"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("source_type"), F.col("source").alias("uri"), F.md5("text").alias("content_hash"), F.col("doc_id").cast(_LONG).alias("observed_at"), pct.alias("trust_pct"), (pct.cast("double") / 100).alias("trust_score"))

    def causal_links(self) -> DataFrame:
        """(cause, effect, mechanism, pct): each user's events in order of id."""
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("event_id")
        e = self.raw("events").select("event_id", "user_id", "event_type", F.lead("event_id").over(w).alias("effect"))
        return e.filter("effect is not null").select(F.col("event_id").cast(_LONG).alias("cause"), F.col("effect").cast(_LONG).alias("effect"), F.col("event_type").alias("mechanism"), (50 + F.col("event_id") % 50).cast(_LONG).alias("pct"))

    def memories(self) -> DataFrame:
        """(id, agent_id, conv_id, content, valid_from, valid_to, status): a role's earlier turns are superseded by its next."""
        from pyspark.sql import Window

        w = Window.partitionBy("conv_id", "role").orderBy("turn")
        m = self.raw("conversations").withColumn("next", F.lead("turn").over(w))
        return m.select(F.concat_ws("-", F.lit("mem"), F.col("conv_id").cast(_TEXT), F.col("turn").cast(_TEXT)).alias("id"), F.col("role").alias("agent_id"), F.col("conv_id").cast(_TEXT).alias("conv_id"), F.col("text").alias("content"), F.col("turn").cast(_LONG).alias("valid_from"), F.col("next").cast(_LONG).alias("valid_to"), F.when(F.col("next").isNull(), "Active").otherwise("Superseded").alias("status"))

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(self._key("vec", "vec_id").alias("id"), "vec_id", "embedding", "label")

    def events_log(self) -> DataFrame:
        """(seq, kind, key, value): the raw event stream as a log."""
        return self.raw("events").select(F.col("event_id").cast(_LONG).alias("seq"), F.col("event_type").alias("kind"), self._key("user", "user_id").alias("key"), "value", "ts")
