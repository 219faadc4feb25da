"""The query language: five statements, parsed here and run as DataFrames.

    stmt := (FIND|MATCH) sel [WHERE pred [sel]] clause*
          | PATH FROM sel [TO sel] [VIA pred ('|' pred)*] clause*
          | CAUSES OF Event("id") clause*
          | CONTRADICTIONS [FOR sel] clause*
          | COUNTERFACTUAL REMOVE (ASSERTION|EVENT)("id") clause*
    sel  := Type | Type("name") | Id("id")

Keywords are case-insensitive, clauses come in any order and the last of a kind
holds. Errors carry the byte position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import temporal as tm
from tempora.operators import contradictions as cx
from tempora.operators import graph as gx
from tempora.operators import select as sx

_TOKEN = re.compile(r'\s*(?:(?P<word>[A-Za-z_][A-Za-z0-9_-]*)|(?P<date>\d{4}-\d{2}-\d{2})|(?P<range>\.\.)|(?P<number>-?\d+(?:\.(?!\.)\d+)?[A-Za-z]*)|"(?P<string>[^"]*)"|(?P<mark>[()|,]))')


class QueryError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at byte {position}")
        self.position = position


@dataclass(frozen=True)
class Selector:
    kind: str  # type, named, id
    type: str | None = None
    name: str | None = None


@dataclass
class Statement:
    verb: str
    subject: Selector | None = None
    predicate: str | None = None
    object: Selector | None = None
    via: list[str] = field(default_factory=list)
    target: tuple[str, str] | None = None
    clauses: dict = field(default_factory=dict)


#: The clauses of each statement.
CLAUSES = {
    "FIND": {"VALID_AT", "KNOWN_AT", "WITH", "MIN_CONFIDENCE", "CONTRADICTIONS", "LIMIT", "RETURN"}, "PATH": {"VALID_AT", "VALID_DURING", "MIN_CONFIDENCE", "MAX_DEPTH", "RETURN"}, "CAUSES": {"WITHIN", "MIN_CONFIDENCE", "MAX_DEPTH", "RETURN"},
    "CONTRADICTIONS": {"VALID_AT", "KNOWN_AT", "RETURN"}, "COUNTERFACTUAL": {"VALID_AT", "MAX_DEPTH", "RETURN"},
}
DEFAULT_DEPTH = 3


def lex(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            bad = at + len(text[at:]) - len(text[at:].lstrip())
            raise QueryError("unexpected character", len(text[:bad].encode()))
        out.append((m.lastgroup, m[m.lastgroup], len(text[: m.start(m.lastgroup)].encode())))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.size = lex(text), 0, len(text.encode())

    def error(self, message: str) -> QueryError:
        return QueryError(message, self.tokens[self.at][2] if self.at < len(self.tokens) else self.size)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def take(self, *kinds: str) -> str:
        kind, value = self.peek()
        if kind not in kinds:
            raise self.error(f"expected {' or '.join(kinds)}")
        self.at += 1
        return value

    def word_is(self, *words: str) -> bool:
        kind, value = self.peek()
        return kind == "word" and value.upper() in words

    def keyword(self, word: str) -> None:
        if not self.word_is(word):
            raise self.error(f"expected {word}")
        self.at += 1

    def mark(self, value: str) -> None:
        if self.peek() != ("mark", value):
            raise self.error(f"expected {value}")
        self.at += 1

    def quoted(self) -> str:
        self.mark("(")
        value = self.take("string")
        self.mark(")")
        return value

    def selector(self) -> Selector:
        word = self.take("word")
        if self.peek() != ("mark", "("):
            return Selector("type", word)
        name = self.quoted()
        return Selector("id", None, name) if word.lower() == "id" else Selector("named", word, name)

    def time(self) -> int:
        kind, value = self.peek()
        if kind not in ("date", "number", "string", "word"):
            raise self.error("expected a time")
        digits = value.replace("-", "") if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else value
        if not re.fullmatch(r"-?\d+", digits):
            raise self.error("expected a time")
        self.at += 1
        return int(digits)

    def number(self, whole: bool = False):
        value = self.peek()[1]
        if not re.fullmatch(r"\d+" if whole else r"\d+(\.\d+)?", value):
            raise self.error("expected a number")
        self.at += 1
        return int(value) if whole else float(value)

    def clauses(self, verb: str) -> dict:
        out: dict = {}
        while self.peek()[0] != "end":
            if not self.word_is(*CLAUSES[verb]):
                raise self.error("unexpected input")
            name = self.take("word").upper()
            if name in ("VALID_AT", "KNOWN_AT"):
                out[name] = self.time()
            elif name == "VALID_DURING":
                start = self.time()
                self.take("range")
                end = self.time()
                if end < start:
                    raise self.error("the interval ends before it starts")
                out[name] = (start, end)
            elif name == "WITH":
                self.keyword("EVIDENCE")
                out[name] = True
            elif name == "MIN_CONFIDENCE":
                out[name] = self.number()
            elif name in ("LIMIT", "MAX_DEPTH"):
                out[name] = self.number(whole=True)
            elif name == "WITHIN":
                out[name] = self.take("number", "string")
            elif name == "RETURN":
                words = [self.take("word")]
                while self.peek() == ("mark", ","):
                    self.at += 1
                    words.append(self.take("word"))
                out[name] = words
            else:
                out[name] = True
        return out

    def statement(self) -> Statement:
        if self.peek()[0] != "word":
            raise self.error("expected a statement")
        verb = self.take("word").upper()
        verb = "FIND" if verb == "MATCH" else verb
        s = Statement(verb)
        if verb == "FIND":
            s.subject = self.selector()
            if self.word_is("WHERE"):
                self.at += 1
                s.predicate = self.take("word")
                if self.peek()[0] == "word" and not self.word_is(*CLAUSES["FIND"]):
                    s.object = self.selector()
        elif verb == "PATH":
            self.keyword("FROM")
            s.subject = self.selector()
            if self.word_is("TO"):
                self.at += 1
                s.object = self.selector()
            if self.word_is("VIA"):
                self.at += 1
                s.via = [self.take("word")]
                while self.peek() == ("mark", "|"):
                    self.at += 1
                    s.via.append(self.take("word"))
        elif verb == "CAUSES":
            self.keyword("OF")
            self.keyword("EVENT")
            s.target = ("EVENT", self.quoted())
        elif verb == "CONTRADICTIONS":
            if self.word_is("FOR"):
                self.at += 1
                s.subject = self.selector()
        elif verb == "COUNTERFACTUAL":
            self.keyword("REMOVE")
            if not self.word_is("ASSERTION", "EVENT"):
                raise self.error("expected ASSERTION or EVENT")
            s.target = (self.take("word").upper(), "")
            s.target = (s.target[0], self.quoted())
        else:
            self.at -= 1
            raise self.error("expected FIND, MATCH, PATH, CAUSES, CONTRADICTIONS or COUNTERFACTUAL")
        s.clauses = self.clauses(verb)
        return s


def parse(text: str) -> Statement:
    return _Parser(text).statement()


#: Retrieval steps of each statement, as its plan lists them.
STEPS = {
    "FIND": ["EntityLookup", "TemporalFilter", "GraphQuery"], "PATH": ["EntityLookup", "PathSearch", "TemporalFilter"], "CAUSES": ["CausalSearch"], "CONTRADICTIONS": ["TemporalFilter", "ContradictionScan"], "COUNTERFACTUAL": ["CausalSearch", "CounterfactualSimulation"],
}


def plan(s: Statement) -> list[str]:
    """The statement's steps; a request for evidence adds the pack."""
    steps = list(STEPS[s.verb])
    if s.clauses.get("WITH") or "evidence" in [w.lower() for w in s.clauses.get("RETURN", [])]:
        steps.append("EvidencePack")
    return steps


def cost(s: Statement) -> float:
    """1, 0.35 for each step and 0.65 for each step that expands, in two places."""
    steps = plan(s)
    return round(1 + 0.35 * len(steps) + 0.65 * sum(x in ("PathSearch", "CausalSearch", "CounterfactualSimulation") for x in steps), 2)


def from_question(text: str) -> str | None:
    """A statement for three kinds of plain questions, else None."""
    for pattern, made in ((r"(?i)^what caused (\S+?)\??$", 'CAUSES OF Event("{0}")'), (r"(?i)^what contradicts (\S+?)\??$", 'CONTRADICTIONS FOR Id("{0}")'), (r"(?i)^how is (\S+) connected to (\S+?)\??$", 'PATH FROM Id("{0}") TO Id("{1}")')):
        if m := re.match(pattern, text.strip()):
            return made.format(*m.groups())
    return None


class Engine:
    """Runs statements over the graph's frames: assertions, entities and causal links."""

    def __init__(self, assertions: DataFrame, entities: DataFrame, causal: DataFrame):
        self.assertions, self.entities, self.causal = assertions, entities, causal

    def resolve(self, s: Selector | None) -> str | None:
        """An id: as given; or the first entity, by id, of the type, whose name or id matches without regard to case."""
        if s is None:
            return None
        if s.kind == "id":
            return s.name
        kinds = {s.type, f"Custom({s.type})", *(["Organization"] if s.type == "Company" else [])}
        of = self.entities.filter(F.col("entity_type").isin(list(kinds)))
        if s.kind == "named":
            of = of.filter((F.lower("canonical_name") == s.name.lower()) | (F.lower("id") == s.name.lower()))
        return of.agg(F.min("id").alias("id")).first()["id"] or (s.name if s.kind == "named" else None)

    def run(self, text: str) -> DataFrame:
        s = parse(text)
        c = s.clauses
        if s.verb == "FIND":
            subject = None if s.subject.kind == "type" else self.resolve(s.subject)  # a bare type doesn't filter
            q = sx.GraphQuery(subject=subject, predicate=s.predicate, obj_entity=self.resolve(s.object), valid_at=c.get("VALID_AT"), known_at=c.get("KNOWN_AT"), min_confidence=c.get("MIN_CONFIDENCE"), limit=c.get("LIMIT"))
            return sx.find(self.assertions, q)
        if s.verb == "PATH":
            start = self.assertions.sparkSession.createDataFrame([(self.resolve(s.subject),)], "id string")
            found = gx.paths(gx.edges(self.assertions), start, c.get("MAX_DEPTH", DEFAULT_DEPTH), self.resolve(s.object), s.via or None, positional=False, valid_at=c.get("VALID_AT"), min_confidence=c.get("MIN_CONFIDENCE"), during=c.get("VALID_DURING"))
            return found.orderBy("hops")
        if s.verb == "CAUSES":
            event = self.assertions.sparkSession.createDataFrame([(s.target[1],)], "id string").select(F.col("id").cast(self.causal.schema["effect"].dataType).alias("id"))
            found = gx.causal_paths(self.causal, event, c.get("MAX_DEPTH", DEFAULT_DEPTH), reverse=True)
            return found.filter(F.col("confidence") >= c["MIN_CONFIDENCE"]) if "MIN_CONFIDENCE" in c else found
        if s.verb == "CONTRADICTIONS":
            # KNOWN_AT is read and has no effect; an unknown entity filters nothing
            rows = self.assertions.filter(tm.valid_at(c["VALID_AT"])) if "VALID_AT" in c else self.assertions
            found = cx.contradictions(rows)
            entity = self.resolve(s.subject)
            if entity is None:
                return found
            touched = rows.filter((F.col("subject") == entity) | (F.col("obj_entity") == entity)).select("id")
            return cx.touching(found, touched)
        kind, name = s.target
        if kind == "EVENT":
            event = self.assertions.sparkSession.createDataFrame([(name,)], "id string").select(F.col("id").cast(self.causal.schema["effect"].dataType).alias("id"))
            return gx.remove_event(self.causal, event, c.get("MAX_DEPTH", DEFAULT_DEPTH))
        gone = self.assertions.filter((F.col("id") == name) & (F.col("status") == "Active"))
        return gone.select(F.explode(F.array_compact(F.array("subject", "obj_entity"))).alias("entity"))
