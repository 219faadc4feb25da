"""From a question to evidence: intent, plan, what it is about, and the compact pack."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm
from tempora.operators import contradictions as cx
from tempora.operators import evidence as pk

#: Words that show an intent; the first row that matches holds.
INTENTS = (
    ("ContradictoryEvidence", ("contradict", "conflict", "disagree", "both sides")), ("Causal", ("cause", "caused", "why", "led to", "impact")), ("AgentMemory", ("remember", "memory", "preference", "agent")),
    ("BroadGlobal", ("broad", "global", "overview", "summarize", "communities", "community")), ("MultiHop", ("multi hop", "through", "chain", "ultimately", "connected", "path")),
    ("Historical", ("historical", "in 2024", "in 2023", "what was true")), ("Relationship", ("relationship", "related", "owns", "works", "supplies", "ceo")),
)
#: Words that show a predicate.
PREDICATES = (("WORKED_AT", ("work", "worked", "employ", "job")), ("OWNS", ("control", "own", "owns", "ownership")), ("CEO_OF", ("ceo", "chief executive")), ("SUPPLIES", ("supply", "supplier")))
#: The tool each operator of a plan needs; Rerank needs none.
TOOLS = {
    "VectorSearch": "VectorIndex", "KeywordSearch": "KeywordIndex", "TemporalFilter": "TemporalIndex", "GraphExpansion": "GraphIndex", "PathSearch": "GraphIndex", "CommunitySearch": "CommunityIndex",
    "CausalExpansion": "CausalGraph", "ContradictionCheck": "ContradictionIndex", "Rerank": None, "Compress": "Compressor", "Cite": "CitationBuilder",
}
_EXTRA = {"ContradictoryEvidence": ["ContradictionCheck"], "Causal": ["CausalExpansion"], "MultiHop": ["PathSearch"], "BroadGlobal": ["CommunitySearch"], "Ambiguous": ["CommunitySearch"]}


@dataclass
class Request:
    question: str
    valid_at: int | None = None
    known_at: int | None = None
    agent: str | None = None
    preferred_predicate: str | None = None
    min_confidence: float | None = None
    items: int = 6
    tools: list[str] = field(default_factory=list)


def normalize(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip().lower().replace("_", " ").replace("-", " "))


def normalized(text: Column) -> Column:
    return fx.normalize_name(F.translate(text, "_-", "  "))


def mentioned(entities: DataFrame, question: str) -> DataFrame:
    """(id) of entities whose id or name stands in the question, by id."""
    q = F.lit(normalize(question))
    return entities.filter(F.contains(q, normalized(F.col("id"))) | F.coalesce(F.contains(q, normalized(F.col("canonical_name"))), F.lit(False))).select("id").orderBy("id")


def intent(r: Request, names_an_entity: bool) -> str:
    q = normalize(r.question)
    for name, words in INTENTS:
        if any(w in q for w in words) or (name == "AgentMemory" and r.agent) or (name == "Historical" and (r.valid_at is not None or r.known_at is not None)):
            return name
    return "SimpleFact" if names_an_entity else "Ambiguous"


def plan(r: Request, of: str) -> list[str]:
    """The operators for an intent, without those whose tool isn't there (all are, if none is named)."""
    steps = ["KeywordSearch", "VectorSearch", *(["TemporalFilter"] if r.valid_at is not None or r.known_at is not None else []), "GraphExpansion", *_EXTRA.get(of, []), "Rerank", "Compress", "Cite"]
    return [s for s in steps if not r.tools or TOOLS[s] is None or TOOLS[s] in r.tools]


def predicate(r: Request, of: str) -> str | None:
    if r.preferred_predicate:
        return r.preferred_predicate
    q = normalize(r.question)
    return next((p for p, words in PREDICATES if any(w in q for w in words)), "CEO_OF" if of == "ContradictoryEvidence" else None)


def compile_pack(r: Request, assertions: DataFrame, entities: DataFrame, sources: DataFrame) -> pk.Pack:
    """The evidence for a question: global assertions of what it mentions, with both sides of contradictions, cut to the budget.

    Sources are those of the assertions that remain.
    """
    about = mentioned(entities, r.question)
    first = about.agg(F.min("id").alias("subject"))
    names = not about.isEmpty()
    p = predicate(r, intent(r, names))
    asked = [F.col("context").isNull()] + ([F.col("predicate") == p] if p else []) + ([tm.valid_at(r.valid_at)] if r.valid_at is not None else []) + ([tm.known_at(r.known_at)] if r.known_at is not None else [])
    asked += [F.col("confidence") >= r.min_confidence] if r.min_confidence is not None else []
    chosen = assertions.filter(tm.all_of(asked))
    if names:
        chosen = chosen.join(F.broadcast(first), "subject", "left_semi")
        near = assertions.join(F.broadcast(first), "subject", "left_semi")
    else:
        near = assertions
    chosen = chosen.orderBy("id").limit(max(1, r.items))
    pack = pk.evidence_pack(chosen, near, entities, sources, cx.contradictions(near))
    pack.assertions = pack.assertions.orderBy("id").limit(r.items)
    kept = pack.assertions.select(F.explode("source_ids").alias("id")).distinct()
    pack.sources = pack.sources.join(kept, "id", "left_semi")
    return pack


def hybrid_scores(question: str, evidence: DataFrame, text: str = "text") -> DataFrame:
    """``evidence`` with keyword and lexical scores, best first by keyword, lexical, id."""
    return evidence.withColumn("keyword", fx.keyword_score(F.lit(question), F.col(text))).withColumn("lexical", F.round(fx.lexical_score(F.lit(question), F.col(text)), 6)).orderBy(F.desc("keyword"), F.desc("lexical"), "id")
