"""Scalar functions with the engine's value semantics, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column, least: int = 1) -> Column:
    """Runs of ASCII letters and digits, lower-cased, of at least ``least`` characters."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def slugify(text: Column, underscore: bool = True) -> Column:
    """ASCII letters and digits (and _) in lower case, other runs as one -, none at the ends; empty: unknown."""
    keep = "a-z0-9_" if underscore else "a-z0-9"
    s = F.regexp_replace(F.regexp_replace(ascii_lower(text), f"[^{keep}]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def normalize_name(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(ascii_lower(text), r"\s+", " "))


def keyword_score(question: Column, text: Column) -> Column:
    """How many of the question's tokens, counted as often as they occur, are among the text's."""
    have = F.array_distinct(tokens(text, 3))
    return F.size(F.filter(tokens(question, 3), lambda t: F.array_contains(have, t)))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(tokens(text)))) / F.size(q)).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """White-space separated words, at least one."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 1).otherwise(F.size(F.split(t, " ")))


def truncate_to_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def parse_timestamp(text: Column) -> Column:
    """YYYY-MM-DD as the integer YYYYMMDD, other integers as they are, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(text, F.lit("-"), F.lit("")).cast("long")).when(text.rlike(r"^[+-]?\d+$"), text.cast("long"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in doubles; 0 where a length is 0, null for different dimensions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def first_iso_date(text: Column) -> Column:
    found = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    return F.when(found != "", found)


def extract_between(text: Column, begin: str, end: str) -> Column:
    """What stands between two markers, without regard to case; null if either is missing."""
    lower = ascii_lower(text)
    at = F.instr(lower, begin.lower())
    start = at + len(begin)
    tail = F.substring(text, start, F.length(text))
    stop = F.instr(F.substring(lower, start, F.length(text)), end.lower())
    return F.when((at > 0) & (stop > 0), F.substring(tail, F.lit(1), stop - 1))


#: Marks of prompt injection, the reason each stands for, and its weight in percent.
INJECTION = (
    ("ignore previous", "ignore previous instructions", 28), ("system prompt", "system prompt extraction", 22), ("hidden prompt", "hidden prompt extraction", 22), ("exfiltrate", "exfiltration request", 30),
    ("api key", "secret extraction request", 20), ("api_key", "secret extraction request", 20), ("reveal", "reveal hidden data request", 12), ("disable safety", "safety bypass request", 20),
)
QUARANTINE = 65


def injection_risk(text: Column) -> Column:
    """Summed weights of the marks that occur, in percent, at most 100."""
    low = ascii_lower(text)
    total = sum((F.when(low.contains(mark), weight).otherwise(0) for mark, _, weight in INJECTION), F.lit(0))
    return F.least(total, F.lit(100))


def injection_reasons(text: Column) -> Column:
    low = ascii_lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(mark), F.lit(reason)) for mark, reason, _ in INJECTION]))


def fnv1a64(data: bytes) -> str:
    """The 64-bit FNV-1a hash as fnv1a64:<16 hex digits>; the content hash of small driver-side values."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"fnv1a64:{h:016x}"


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def source_trust_baseline(kind: Column) -> Column:
    """How far each kind of source is trusted to begin with."""
    values = {"Document": 0.74, "WebPage": 0.48, "DatabaseRecord": 0.82, "ApiResponse": 0.76, "HumanReport": 0.58, "SensorReading": 0.72}
    out = F.lit(0.5)
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def parse_duration(text: Column) -> tuple[Column, Column]:
    """(amount, unit) of digits followed by a unit; nulls for anything else."""
    ok = text.rlike(r"(?s)^[0-9]+[^0-9].*$")
    digits = F.regexp_extract(text, r"^([0-9]+)", 1)
    return F.when(ok, F.try_to_number(digits, F.lit("9" * 18)).cast("long")), F.when(ok, F.substring(text, F.length(digits) + 1, F.length(text)))


def byte_embedding(text: Column) -> Column:
    """Four numbers: the bytes of the text by their place modulo four, as shares of 255, over its length; zeros for an empty text."""
    digits = F.hex(F.encode(text, "utf-8"))
    n = F.octet_length(text)
    byte = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("double"))
    one = lambda k: F.aggregate(F.filter(byte, lambda x, i: i % 4 == k), F.lit(0.0), lambda a, x: a + x) / 255 / n
    return F.when(n > 0, F.array(*[one(k) for k in range(4)])).otherwise(F.array(*[F.lit(0.0)] * 4))


def one_hot(index: Column, size: int = 4) -> Column:
    return F.array(*[F.when(F.pmod(index, F.lit(size)) == k, 1.0).otherwise(0.0) for k in range(size)])


#: How many memory ids in one text count as a bulk request.
BULK_MEMORY_IDS = 3


def exfiltration(text: Column, has_secret: Column) -> Column:
    """Whether a text asks for memories in bulk (three times memory_id=) or carries a secret."""
    return (F.regexp_count(text, F.lit("memory_id=")) >= BULK_MEMORY_IDS) | has_secret
