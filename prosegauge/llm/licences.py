"""Licence scans.

An Aho-Corasick automaton over words finds notice phrases; a second one over the raw text finds identifier tags, whose
and/or/with expressions a shunting-yard parser turns into postfix form and evaluates to licence labels, the licences
one must accept in any case, and whether some choice is permissive.  A licence that ``or`` lets one do without is a
label but not required, and counts half in the score; ``with`` puts the licence with its exception in the place of
the licence; a text with several expressions needs what any of them needs, and is permissive if all of them are.

Texts are scanned whole, each once, in bounded slices; there is no shuffle.  Words are maximal runs of digits, letters
and non-ASCII characters after A-Z are lower-cased, so a phrase is found across any ASCII punctuation and line ends
but never inside a longer word.  Nulls and edge cases: a null text is an empty one (no words, no labels, score 0);
overlapping places all count; repeated rows give equal rows; a malformed expression gives the label ``unparsed`` and,
as labels that are not required, the identifiers that it names.  An empty table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts_of

#: Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licences by how notices name them: names (words as the scan sees them), label, versions.
FAMILIES = (
    (("apache", "apache software"), "apache", ("1.1", "2.0")),
    (("mit", "x11"), "mit", ()),
    (("bsd", "modified bsd", "simplified bsd"), "bsd", ()),
    (("isc",), "isc", ()),
    (("zlib",), "zlib", ()),
    (("boost software",), "bsl", ("1.0",)),
    (("mpl", "mozilla public"), "mpl", ("1.1", "2.0")),
    (("epl", "eclipse public"), "epl", ("1.0", "2.0")),
    (("gpl", "gnu gpl", "gnu general public"), "gpl", ("1", "2", "3")),
    (("lgpl", "gnu lgpl", "lesser general public", "library general public"), "lgpl", ("2", "2.1", "3")),
    (("agpl", "gnu agpl", "affero general public"), "agpl", ("3",)),
    (("eupl", "european union public"), "eupl", ("1.1", "1.2")),
    (("artistic",), "artistic", ("1.0", "2.0")),
    (("cc by", "creative commons attribution"), "cc-by", ("2.0", "3.0", "4.0")),
    (("cc by sa", "creative commons attribution sharealike"), "cc-by-sa", ("3.0", "4.0")),
    (("cc by nc", "creative commons attribution noncommercial"), "cc-by-nc", ("3.0", "4.0")),
    (("cc by nd",), "cc-by-nd", ("3.0", "4.0")),
    (("cc by nc sa",), "cc-by-nc-sa", ("3.0", "4.0")),
    (("cc by nc nd",), "cc-by-nc-nd", ("3.0", "4.0")),
)
#: What makes a name a notice, before it or behind it.  A name of two words and more, or with its version, needs neither.
BEFORE, BEHIND = ("under", "under the", "license", "licence"), ("license", "licence", "licensed")
#: Notices that no family has.
OTHERS = {
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "unlicense": "unlicense",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "this work is licensed under": "notice",
    "licensed under": "notice",
    "released under": "notice",
    "distributed under": "notice",
    "used with permission": "permission",
    "do not redistribute": "reserved",
    "unauthorized copying": "reserved",
    "proprietary and confidential": "proprietary",
    "confidential": "confidential",
}


def notices_of(families: Iterable[tuple[tuple[str, ...], str, tuple[str, ...]]] = FAMILIES) -> dict[str, str]:
    """Phrases and labels: each name as a notice, and each name with each of its versions in the usual spellings."""
    out = dict(OTHERS)
    for names, label, versions in families:
        for name in names:
            known = [f"{b} {name}" for b in BEFORE] + [f"{name} {b}" for b in BEHIND] + [name] * (" " in name)
            out |= {phrase: label for phrase in known}
            for version in versions:
                number = version.replace(".", " ")
                short = number.removesuffix(" 0")
                for spelt in {number, short}:
                    for form in (f"{name} {spelt}", f"{name} v{spelt}", f"{name} version {spelt}", f"{name} license {spelt}", f"{name} license v{spelt}", f"{name} license version {spelt}", f"{name}v{spelt}"):
                        out[form] = f"{label}-{version if '.' in version else version + '.0'}"
    return out


#: Notice phrases (words as the scan sees them) and labels of this operator's own.
NOTICES = notices_of()

#: Tags (lower case) that a licence expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")

#: Beginnings of identifiers whose licences are permissive.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "cc-by-3", "unlicense", "zlib", "0bsd", "public-domain", "bsl", "python", "postgresql")

#: Labels that count half in the score: no licence is named.
WEAK = {"notice", "confidential", "permission"}

SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """The expression in postfix form by the shunting-yard method; ValueError if it is malformed.

    Operators, whatever their case: or, and, with, in the order of binding; all group to the left.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what may come next
    at, expression = 0, expression.strip()
    while at < len(expression):
        m = TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"unexpected {expression[at : at + 10]!r}")
        at, token = m.end(), m[1]
        word = token.lower()
        if word in RANK:
            if operand:
                raise ValueError(f"{token} without a left side")
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError("a group after an identifier")
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError("an empty side before )")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(") without (")
            stack.pop()
        else:
            if not operand:
                raise ValueError("two identifiers side by side")
            out.append(token)
            operand = False
    if operand:
        raise ValueError("an open end")
    while stack:
        if stack[-1] == "(":
            raise ValueError("( without )")
        out.append(stack.pop())
    return out


def evaluate(expression: str) -> tuple[set[str], set[str], bool]:
    """Licences (lower case), those of them that every choice needs, and whether some choice is all permissive.

    ``a with x`` is one licence named so, and permissive if ``a`` is; with a group on its left, each licence of it.
    """
    stack: list[tuple[set[str], set[str], bool]] = []
    for token in postfix(expression):
        word = token.lower()
        if word not in RANK:
            stack.append(({word}, {word}, word.startswith(PERMISSIVE)))
            continue
        b, a = stack.pop(), stack.pop()
        if word == "with":
            named = [{f"{x} with {y}" for x in part for y in sorted(b[0])} for part in a[:2]]
            stack.append((named[0], named[1], a[2]))
        elif word == "and":
            stack.append((a[0] | b[0], a[1] | b[1], a[2] and b[2]))
        else:
            stack.append((a[0] | b[0], a[1] & b[1], a[2] or b[2]))
    return stack[-1]


def automaton(keys: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in keys:
        out.add_word(key, value)
    out.make_automaton()
    return out


@lru_cache(maxsize=4)
def _automata(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases: dict[str, list[tuple[str, bool]]] = {}
    for items, own in ((base, True), (notices, False)):
        for phrase, label in items:
            phrases.setdefault(f" {phrase} ", []).append((label, own))
    return automaton((p, (len(p), tuple(v))) for p, v in phrases.items()), automaton((t, len(t)) for t in TAGS)


def expression_after(line: str) -> str:
    """The expression at the beginning of ``line``: identifiers, operators and parentheses, while they alternate."""
    depth, end, at, operand = 0, 0, 0, True
    while m := TOKEN.match(line, at):
        word = m[1].lower()
        if word in RANK:
            if operand:
                break
            operand = True
        elif m[1] == "(":
            if not operand:
                break
            depth += 1
        elif m[1] == ")":
            if not depth or operand:
                break
            depth -= 1
            end = m.end()
        elif operand:
            operand, end = False, m.end()
        else:
            break
        at = m.end()
        if word == ")" or not operand:
            end = at
    return line[:end].rstrip(".:")


class Scan(NamedTuple):
    """What a text says of its licences; ``permissive`` is null without a parsed expression."""

    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: set[str]
    labels: set[str]
    required: set[str]
    permissive: bool | None
    expressions: int
    score: float
    places: list[tuple[int, str]]


def _joined(text: str) -> str:
    """The words of a text with one space around each."""
    return " " + b" ".join(text.encode().translate(SPACES).split()).decode() + " "


def scan(text: str, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES) -> Scan:
    """Base phrases count wherever they stand, notices only outside of expressions."""
    phrases, tags = _automata(tuple(base.items()), tuple(notices.items()))
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text) if any(t[:8] in text.lower() for t in TAGS) else ""
    required: set[str] = set()
    optional: set[str] = set()
    permissive: list[bool] = []
    expressions, plain = 0, text
    for end, _ in tags.iter(low) if low else ():
        line = text[end + 1 : (text.find("\n", end + 1) + 1 or len(text) + 1) - 1]
        stated = expression_after(line)
        expressions += 1
        plain = plain[: end + 1] + re.sub(r"[A-Za-z0-9]", "q", stated) + plain[end + 1 + len(stated) :]  # the same places
        try:
            names, needed, free = evaluate(stated)
            required |= needed
            optional |= names - needed
            permissive.append(free)
        except ValueError:
            required.add("unparsed")
            optional |= {m[1].lower() for m in TOKEN.finditer(stated) if m[1] not in "()" and m[1].lower() not in RANK}
    body = _joined(text)
    hits = [(end - size + 1, label, own) for end, (size, found) in phrases.iter(body) for label, own in found if own or not expressions]
    if expressions:
        hits += [(end - size + 1, label, own) for end, (size, found) in phrases.iter(_joined(plain)) for label, own in found if not own]
    places: list[tuple[int, str]] = []
    starts: list[int] = []
    own_labels: set[str] = set()
    before = at = 0
    for start, label, own in sorted(hits):
        before += body.count(" ", at, start)
        at = start
        places.append((before, label))
        required.add(label)
        if own:
            own_labels.add(label)
            starts.append(before)
    labels = required | optional
    half = (labels & WEAK) | (optional - required)
    score = 1 - 0.5 ** (len(labels - half) + 0.5 * len(half))
    return Scan(body.count(" ") - 1 if body.strip() else 0, len(starts), min(starts, default=None), max(starts, default=None), own_labels, labels, required - WEAK, all(permissive) if permissive else None, expressions, score, places)


def scan_licences(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, required (labels that no choice does
    without), permissive, expressions, and places (word and label of each find)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        joined = lambda x: ",".join(sorted(x))
        rows = []
        for t in texts_of(part.column(1)).to_pylist():
            s = scan(t, base, notices)
            rows.append((s.n_words, s.n_base, s.first_word, s.last_word, joined(s.base_labels), joined(s.labels), s.score, joined(s.required), s.permissive, s.expressions, [{"word": w, "label": x} for w, x in s.places]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "required", "permissive", "expressions", "places"]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string, permissive boolean, expressions long, places array<struct<word:long,label:string>>"
    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), run, schema)
