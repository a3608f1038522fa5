"""Personal data by weak supervision.

Candidate spans come from strict patterns and from wider ones (spelled-out e-mail addresses, phone
numbers without a country code, IPv6, card-like numbers). Labelers vote for or against each
candidate, or abstain: pattern, checksum or plausibility, gazetteer, words nearby that suggest the
kind, and signs nearby that speak against it. Expectation maximisation estimates per kind how
reliable each labeler is, without labels, from the counts of vote patterns; there are at most
3^labelers of them, whatever the input. Its posteriors then train a logistic span classifier on
the span's shape and votes, which decides about the wider candidates. Strict spans always stay."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import in_slices, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "plausible", "gazetteer", "context", "counter")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]++")
# The leftmost match begins where a run of digits does, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:\+?[0-9]{1,3}\x20)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
}
# Gazetteers: common top-level domains, and first digits of card issuers.
_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl us ca au co biz".split())
_ISSUERS = "3456"
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|cvv|iban)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|cell|whatsapp|telefon|dial)\b", re.I),
}
_COUNTER = re.compile(r"\b(?:version|isbn|issn|order|invoice|section|chapter|build|release|token|sha1|md5|serial)\b", re.I)
_SHAPES = 4          # bits of shape per candidate


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the strict patterns: the leftmost, non-overlapping matches of
    each kind that pass its test."""
    out = []
    if "@" in text:
        for run in _EMAIL_RUN.finditer(text):
            if "@" not in run[0]:
                continue
            out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text, run.start(), run.end())]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _wide_spans(text: str, strict: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the wider patterns that overlap no strict one."""
    found = []
    low = text.lower() if "(at" in text or "[at" in text or "{at" in text or "AT" in text else ""
    if low and ("(at)" in low or "[at]" in low or "{at}" in low):
        found += [(m.start(), 0, m.end()) for m in _WIDE["email"].finditer(text)]
    if text.count(":") > 3:
        found += [(m.start(), 1, m.end()) for m in _WIDE["ip"].finditer(text)]
    found += [(m.start(), 3, m.end()) for m in _WIDE["phone"].finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(_digits(m[0])) <= 19:
            found.append((m.start(), 2, m.end()))
    starts = [a for a, _, _ in strict]
    furthest = list(accumulate((b for _, _, b in strict), max))      # end among the first strict spans
    return [s for s in sorted(set(found)) if not (k := bisect_left(starts, s[2])) or furthest[k - 1] <= s[0]]


def _votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, int]:
    """Votes (base 3: 0 abstains, 1 against, 2 for; the first labeler lowest) and shape bits."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    around = text[max(0, start - 40):start] + " " + text[end:end + 20]
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    if name == "email":
        tail = re.split(r"[.\s)\]}]+", span.lower())[-1]
        plausible, known = (2 if 2 <= len(tail) <= 12 and not tail.isdigit() else 1), (2 if tail in _DOMAINS else 0)
    elif name == "ip":
        plausible, known = (2 if strict or span.count(":") in (5, 7) else 1), (1 if span.startswith("0") else 0)
    elif name == "card":
        plausible, known = (2 if luhn(digits) else 1), (2 if digits[0] in _ISSUERS else 1)
    else:
        plausible, known = (2 if 10 <= len(digits) <= 15 and len(set(digits)) > 2 else 1), (1 if digits[:3] in ("000", "123") else 0)
    cast = (2 if strict else 0, plausible, known, 2 if _CONTEXT[name].search(around) else 0, 1 if glued or _COUNTER.search(around) else 0)
    shape = (" " in span) | (len(span) > 16) << 1 | (len(digits) % 2) << 2 | bool(glued) << 3
    return sum(v * 3 ** k for k, v in enumerate(cast)), shape


def candidates(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` and spans: kind, start, end (code points, end excluded), strict, votes, shape."""
    def run(batch):
        spans = []
        for text in batch.column("_text").to_pylist():
            own = strict_spans(text)
            rows = [(s, True) for s in own] + [(s, False) for s in _wide_spans(text, own)]
            spans.append([dict(zip(("kind", "start", "end", "strict", "votes", "shape"), (k, a, b, strict, *_votes(text, a, k, b, strict))))
                          for (a, k, b), strict in sorted(rows)])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()),
                                   ("votes", pa.int32()), ("shape", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(spans, kind)], names=[*columns, "spans"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
                       + ["spans array<struct<kind: int, start: bigint, end: bigint, strict: boolean, votes: int, shape: int>>"])
    return docs.select(*columns, text_or_empty().alias("_text")).mapInArrow(in_slices(run, "_text"), schema)


def unpack_votes(code: int) -> list[int]:
    return [code // 3 ** k % 3 for k in range(len(LABELERS))]


def label_model(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior that a span is personal data, per vote pattern, by expectation maximisation: two
    classes, labelers independent given the class, each with its own chance of every vote. It
    starts from the votes' majority."""
    codes = sorted(counts)
    votes = np.array([unpack_votes(c) for c in codes])
    weight = np.array([counts[c] for c in codes], dtype=float)
    post = 1 / (1 + np.exp(-((votes == 2).sum(1) - (votes == 1).sum(1) - 0.5)))
    for _ in range(rounds):
        pos, neg = weight * post, weight * (1 - post)
        prior = (pos.sum() + 1) / (weight.sum() + 2)
        log = np.full(len(codes), np.log(prior) - np.log(1 - prior))
        for k in range(votes.shape[1]):
            for v in range(3):
                at = votes[:, k] == v
                log[at] += np.log((pos[at].sum() + 0.5) / (pos.sum() + 1.5)) - np.log((neg[at].sum() + 0.5) / (neg.sum() + 1.5))
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return dict(zip(codes, post.tolist()))


def _features(votes: int, shape: int) -> list[float]:
    cast = unpack_votes(votes)
    return [1.0, *[float(v == 2) for v in cast], *[float(v == 1) for v in cast], *[float(shape >> k & 1) for k in range(_SHAPES)]]


def span_classifier(patterns: list[tuple[int, int, int]], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Probability per (votes, shape) of (votes, shape, count), of one kind: logistic regression on
    the label model's posteriors, weighted by counts."""
    by_votes: dict[int, int] = defaultdict(int)
    for votes, _, n in patterns:
        by_votes[votes] += n
    post = label_model(by_votes)
    x = np.array([_features(v, s) for v, s, _ in patterns])
    y = np.array([post[v] for v, _, _ in patterns])
    n = np.array([c for _, _, c in patterns], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) + w)
        w -= step * min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return {(v, s): float(p) for (v, s, _), p in zip(patterns, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))}


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, end, strict, probability), in order: all strict spans and the
    wider ones at `threshold` or more. Null and empty texts have none; extra columns are ignored;
    repeated rows each have a row; an empty table gives an empty one."""
    spark = docs.sparkSession
    found = table(candidates(docs, "doc_id"), "spans")
    seen = (found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count().collect())
    per_kind = defaultdict(list)
    for r in sorted(seen):
        per_kind[r["kind"]].append((r["votes"], r["shape"], r["count"]))
    chance = {(kind, *key): p for kind, rows in per_kind.items() for key, p in span_classifier(rows).items()}
    given = spark.sparkContext.broadcast(chance)

    def decide(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                scored = [(s, given.value[s["kind"], s["votes"], s["shape"]]) for s in spans]
                out.append([{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "strict": s["strict"], "probability": p}
                            for s, p in scored if s["strict"] or p >= threshold])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(decide, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, strict: boolean, probability: double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the strict spans, their digest, and all spans as one string."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    strict = F.filter("spans", lambda s: s["strict"])
    kinds = F.transform(strict, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(strict), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
