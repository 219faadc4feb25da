"""The optional ontology: a small configuration, and checks of entities and assertions against it as joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.contradictions import overlapping_pairs


@dataclass
class Ontology:
    """Types with their properties, predicates with subject and object types and how many objects may hold at once."""

    types: dict[str, dict[str, str]] = field(default_factory=dict)
    predicates: dict[str, dict] = field(default_factory=dict)

    def predicate_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, x.get("subject", "Entity"), x.get("object", "Entity"), x.get("max")) for p, x in self.predicates.items()]
        return spark.createDataFrame(rows, "predicate string, want_subject string, want_object string, most int")


def read_ontology(text: str) -> Ontology:
    """An ontology out of the indented ``key: value`` text that its files use."""
    out, path = Ontology(), []
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare.strip():
            continue
        depth = (len(bare) - len(bare.lstrip())) // 2
        key, _, value = (x.strip() for x in bare.strip().partition(":"))
        path = [*path[:depth], key]
        if len(path) >= 2 and path[0] == "entity_types":
            properties = out.types.setdefault(path[1], {})
            if len(path) == 4 and path[2] == "properties":
                properties[key] = value
        elif len(path) >= 2 and path[0] == "predicates":
            p = out.predicates.setdefault(path[1], {})
            if len(path) == 3 and value:
                p[key] = value
            elif len(path) == 4 and key == "max_active_objects_per_subject":
                p["max"] = int(value)
    return out


def read_exclusive_pairs(spark: SparkSession, text: str) -> DataFrame:
    """(predicate_a, predicate_b) of ``a | b`` lines with # comments."""
    rows = [tuple(x.strip() for x in line.split("|")) for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
    if any(len(r) != 2 or not all(r) for r in rows):
        raise ValueError("a line holds two predicates")
    return spark.createDataFrame(rows, "predicate_a string, predicate_b string")


def _fits(want, actual):
    company = (want == "Company") & (actual == "Organization")
    return (want == "Entity") | (want == actual) | company | (actual == F.concat(F.lit("Custom("), want, F.lit(")")))


def assertion_violations(assertions: DataFrame, entities: DataFrame, ontology: Ontology) -> DataFrame:
    """(id, rule): unknown predicates, unknown or wrongly typed ends, objects that are no entity, too many objects at once."""
    p = F.broadcast(ontology.predicate_frame(assertions.sparkSession))  # configuration
    types = entities.select("id", "entity_type")
    t = assertions.join(p, "predicate", "left").join(types.select(F.col("id").alias("subject"), F.col("entity_type").alias("st")), "subject", "left").join(types.select(F.col("id").alias("obj_entity"), F.col("entity_type").alias("ot")), "obj_entity", "left")
    rule = F.when(F.col("want_subject").isNull(), "unknown-predicate").when(F.col("st").isNull(), "unknown-subject").when(~_fits(F.col("want_subject"), F.col("st")), "subject-type")
    rule = rule.when(F.col("obj_kind") != "Entity", "object-type").when(F.col("ot").isNull(), "unknown-object").when(~_fits(F.col("want_object"), F.col("ot")), "object-type")
    single = assertions.filter("status = 'Active'").join(p.filter("most = 1").select("predicate"), "predicate", "left_semi")
    other = ~F.coalesce(F.col("l_obj_entity"), F.col("l_obj_text")).eqNullSafe(F.coalesce(F.col("r_obj_entity"), F.col("r_obj_text")))
    many = overlapping_pairs(single, ["subject", "context", "predicate"], ["obj_entity", "obj_text"], other)
    ends = many.select(F.explode(F.array("l_id", "r_id")).alias("id")).distinct().withColumn("rule", F.lit("max-active-objects"))
    return t.select("id", rule.alias("rule")).filter("rule is not null").union(ends)


def entity_violations(entities: DataFrame, ontology: Ontology) -> DataFrame:
    """(id, rule) of entities (id, entity_type, properties map) of unknown types or without a property of their type."""
    spark = entities.sparkSession
    rows = [(t, sorted(p)) for t, p in ontology.types.items()]
    types = F.broadcast(spark.createDataFrame(rows, "want string, properties_wanted array<string>"))
    t = entities.join(types, _fits(F.col("want"), F.col("entity_type")), "left")
    missing = F.size(F.array_except("properties_wanted", F.coalesce(F.map_keys("properties"), F.array().cast("array<string>")))) > 0
    return t.select("id", F.when(F.col("want").isNull(), "unknown-type").when(missing, "missing-property").alias("rule")).filter("rule is not null")
