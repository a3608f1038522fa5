"""Licences in texts: one Aho-Corasick automaton over a text's words finds notice phrases and
identifier tags; the expression behind a tag (`MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)`)
is read by a shunting-yard parser and evaluated."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import in_slices, text_or_empty

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Words behind which an expression stands.
TAGS = ("spdx license identifier", "license expression")
#: Families of identifiers, and whether their texts may be used without conditions on the whole.
FAMILIES = {
    "agpl": False, "lgpl": False, "gpl": False, "gfdl": False, "mpl": True, "epl": False, "eupl": False, "apache": True,
    "bsd": True, "bsl": True, "mit": True, "isc": True, "zlib": True, "unlicense": True, "0bsd": True, "cc0": True,
    "cc-by-nc-sa": False, "cc-by-nc-nd": False, "cc-by-nc": False, "cc-by-nd": False, "cc-by-sa": False, "cc-by": True,
}
#: Exceptions that lift the conditions of the licence they are added to.
EXCEPTIONS = ("classpath-exception", "gcc-exception", "llvm-exception", "autoconf-exception", "bison-exception", "font-exception")
#: How surely each kind of evidence shows a licence.
WEIGHTS = {"tag": 0.99, "base": 0.9, "notice": 0.8}

_FOLD = bytes(k if k >= 128 or 97 <= k <= 122 or 48 <= k <= 57 else k + 32 if 65 <= k <= 90 else 32 for k in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"[ \t\f\v\r]*([()]|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


# ------------------------------------------------------------------ expressions

def tokens(text: str) -> Iterator[str]:
    """Parentheses, operators in lower case and identifiers, up to the line's end or the first
    character that is none of them."""
    at = 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        word = m[1]
        yield word.lower() if word.lower() in _RANK else word


def to_postfix(text: str) -> list[str]:
    """The longest expression at the beginning of `text` in postfix order (shunting-yard; `with`
    binds closest, then `and`, then `or`, all to the left). It ends before a word that cannot
    follow; an operator without right side is left out, and so is a parenthesis that has no partner."""
    out, stack, operand = [], [], False
    for t in tokens(text):
        if t in _RANK:
            if not operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand or (stack and stack[-1] == "with"):
                break
            stack.append(t)
        elif t == ")":
            if not operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            if operand:
                break
            out.append(t)
            operand = True
    # an operator that waits for its right side is the last one pushed, parentheses aside
    while not operand and stack:
        if stack.pop() != "(":
            operand = True
    out += [t for t in reversed(stack) if t != "("]
    return out if any(t not in _RANK for t in out) else []


def family(identifier: str) -> str:
    """The family an identifier belongs to, or itself in lower case."""
    name = identifier.lower()
    return next((f for f in FAMILIES if name == f or name.startswith(f + "-")), name.rstrip("+"))


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """Labels of an expression and whether it may be used freely: `or` leaves the choice, `and`
    binds to both, `with` lifts conditions if its right side is such an exception. None if there is
    no expression."""
    stack: list = []
    for t in postfix:
        if t not in _RANK:
            stack.append(({family(t)}, FAMILIES.get(family(t), False), t))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            lifts = right[2].lower().startswith(EXCEPTIONS)
            stack.append((left[0] | {right[2].lower()}, left[1] or lifts, left[2]))
        else:
            free = left[1] or right[1] if t == "or" else left[1] and right[1]
            stack.append((left[0] | right[0], free, ""))
    return (stack[0][0], stack[0][1]) if stack else None


# ------------------------------------------------------------------ search

@functools.cache
def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS))):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 2, kind, label))
    made.make_automaton()
    return made


def find(text: str | None):
    """Number of words; hits (label, kind, first word, words) by first word; expressions
    (text, labels, free)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = sorted((end - size + 1, n, kind, label) for end, (n, size, kind, label) in _automaton().iter(line)
                   ) if len(words) > 1 else []
    hits, tags, at, before = [], [], 0, 0
    for start, n, kind, label in found:
        before += line.count(" ", at, start)
        at = start
        if kind == "tag":
            tags.append(before + n)
        else:
            hits.append((label, kind, before, n))
    expressions = []
    if tags:
        spans = [m.end() for m in _WORD.finditer(raw)]
        for after in tags:
            stop = raw.find(b"\n", spans[after - 1])
            rest = raw[spans[after - 1]:stop if stop >= 0 else len(raw)].decode("utf-8", "replace").lstrip(" \t:=\"'")
            postfix = to_postfix(rest)
            value = evaluate(postfix)
            if value:
                expressions.append((" ".join(postfix), sorted(value[0]), value[1]))
                n = sum(1 for t in postfix if t not in _RANK)
                hits += [(label, "tag", after, n) for label in sorted(value[0])]
    return len(words), hits, expressions


_HIT = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("n", pa.int64())])
_EXPRESSION = pa.struct([("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("free", pa.bool_())])


def scan(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` of `docs`, n_words, hits (label, kind, first word, words) and expressions (postfix,
    labels, free) of each row's whole `text`. Null and empty texts have none; repeated rows each
    have a row; an empty table gives an empty one. `columns` must not be named like the results."""
    def run(batch):
        got = [find(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in columns]
            + [pa.array([g[0] for g in got], pa.int64()),
               pa.array([[dict(zip(("label", "kind", "first", "n"), h)) for h in g[1]] for g in got], pa.list_(_HIT)),
               pa.array([[dict(zip(("postfix", "labels", "free"), e)) for e in g[2]] for g in got], pa.list_(_EXPRESSION))],
            names=[*columns, "n_words", "hits", "expressions"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
                       + ["n_words long", "hits array<struct<label:string,kind:string,first:long,n:long>>",
                          "expressions array<struct<postfix:string,labels:array<string>,free:boolean>>"])
    return docs.select(*columns, text_or_empty().alias("_text")).mapInArrow(in_slices(run, "_text"), schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and `free`: whether
    every expression of the document may be used freely (null without one). The score is the chance
    that not all evidence errs: each distinct (label, kind) errs with 1 - its weight."""
    base = F.filter("hits", lambda h: h["kind"] == "base")
    first = F.transform(base, lambda h: h["first"])

    def joined(hits):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    kinds = F.transform(F.array_distinct(F.transform("hits", lambda h: F.struct(h["label"], h["kind"].alias("kind")))), lambda h: h["kind"])
    def errs(kind):
        return F.pow(F.lit(1 - WEIGHTS[kind]), F.size(F.filter(kinds, lambda k: k == kind)))

    doubt = errs("base") * errs("notice") * errs("tag")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("hits")).alias("labels"), (1 - doubt).alias("score"),
        F.when(F.size("expressions") > 0, F.forall("expressions", lambda e: e["free"])).alias("free"))
