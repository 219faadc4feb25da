"""The query machine of the atom kernel: bitemporal questions and native statements, compiled to a plan and run.

atoms, deps and revisions are those of ``kernel``; links are causal (cause,
effect, pct).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import graph as gx
from tempora.operators import kernel as kx

#: The nine questions, by what answers them.
STATE_QUESTIONS = ("EntityState", "WhatIsTrueNow", "WhatWasTrueAt", "WhatDidWeBelieveAt")
OTHER_QUESTIONS = ("WhenDidBeliefChange", "IfSourceFalseWhatCollapses", "WhatCaused", "WhatMightHappenNext", "WhatBreaksIfEventDoesNotOccur")
#: Kinds of native statements and the strategy each is run by.
STRATEGIES = {"VerifyClaim": "PointInTimeLookup", "WhatBreaksIfFalse": "CounterfactualImpactSearch", "CausalCauses": "CausalTraversal", "CausalEffects": "CausalTraversal"}
BOUND_STRATEGY = "LeapfrogTriejoinCandidate"


@dataclass
class Question:
    """One of the nine questions; what it doesn't need stays None."""

    kind: str
    entity: str | None = None
    valid_at: int | None = None
    known_at: int | None = None
    target: object = None
    depth: int = 3
    ai_facing: bool = False


@dataclass
class Native:
    """A native statement: a claim pattern, an atom or an event, with operators and the fields to return."""

    kind: str
    subject: str | None = None
    predicate: str | None = None
    obj: str | None = None
    valid_at: int | None = None
    known_at: int | None = None
    target: object = None
    depth: int = 3
    labels: list[str] | None = None
    ai_facing: bool = False
    operators: list[str] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)


def compile_native(q: Native) -> tuple[str, list[str]]:
    """(strategy, trace of steps): the strategy, the operators in order, and a dependency walk that a returned field needs."""
    if q.kind not in STRATEGIES:
        raise ValueError(f"no native statement is called {q.kind}")
    bound = q.kind == "VerifyClaim" and None not in (q.subject, q.predicate, q.obj)
    strategy = BOUND_STRATEGY if bound else STRATEGIES[q.kind]
    walk = ["DependencyTrace"] if "DependencyTrace" in q.returns and "DependencyTrace" not in q.operators else []
    return strategy, [strategy, *q.operators, *walk]


class Machine:
    def __init__(self, atoms: DataFrame, revisions: DataFrame, deps: DataFrame, links: DataFrame):
        self.atoms, self.revisions, self.deps, self.links = atoms, revisions, deps, links

    def _one(self, value, kind: str) -> DataFrame:
        return self.atoms.sparkSession.createDataFrame([(value,)], f"id {kind}")

    def run(self, q: Question) -> DataFrame:
        """The answer as rows: an entity's atoms with their belief then, revisions, what collapses, or causal paths."""
        if q.kind in STATE_QUESTIONS:
            found = kx.entity_state(self.atoms, self.revisions, q.entity, q.valid_at, q.known_at)
            return found.filter(kx.supported_for_ai()) if q.ai_facing else found
        if q.kind == "WhenDidBeliefChange":
            return self.revisions.filter(F.col("atom_id") == q.target).orderBy("known_at", "seq")
        if q.kind == "IfSourceFalseWhatCollapses":
            return kx.impact_if_retracted(self.deps, self._one(q.target, "string"))
        if q.kind in ("WhatCaused", "WhatMightHappenNext"):
            return gx.causal_paths(self.links, self._one(q.target, "bigint"), q.depth, reverse=q.kind == "WhatCaused", rule="min")
        if q.kind == "WhatBreaksIfEventDoesNotOccur":
            return gx.reachable_within(self.links.select(F.col("cause").alias("a"), F.col("effect").alias("b")), self._one(q.target, "bigint"), q.depth)
        raise ValueError(f"no question is called {q.kind}")

    def native(self, q: Native) -> DataFrame:
        compile_native(q)
        if q.kind == "VerifyClaim":
            return kx.verify_claim(self.atoms, self.revisions, q.subject, q.predicate, q.obj, q.valid_at, q.known_at, q.labels, q.ai_facing)
        if q.kind == "WhatBreaksIfFalse":
            return kx.impact_if_retracted(self.deps, self._one(q.target, "string"))
        return gx.causal_paths(self.links, self._one(q.target, "bigint"), q.depth, reverse=q.kind == "CausalCauses", rule="min")
