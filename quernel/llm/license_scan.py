"""Licence scan: Aho-Corasick for tags and notices, shunting-yard for expressions."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from quernel.llm._shared import built_once, keyed, map_batches, new_key, plain_words

# The phrases that are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notices, by the families that licence identifiers begin with.
NOTICES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl",
    "free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl", "eclipse distribution license": "bsd", "common public license": "cpl",
    "ibm public license": "ipl", "common development and distribution license": "cddl", "sun public license": "spl", "apple public source license": "apsl", "european union public licence": "eupl",
    "microsoft public license": "ms-pl", "microsoft reciprocal license": "ms-rl", "open software license": "osl", "academic free license": "afl", "artistic license": "artistic",
    "perl artistic license": "artistic", "python software foundation license": "psf", "psf license": "psf", "php license": "php", "ruby license": "ruby", "zope public license": "zpl",
    "zlib license": "zlib", "zlib libpng license": "zlib", "libpng license": "libpng", "isc license": "isc", "x11 license": "x11", "boost software license": "bsl", "postgresql license": "postgresql",
    "openssl license": "openssl", "ncsa open source license": "ncsa", "w3c software notice and license": "w3c", "educational community license": "ecl", "universal permissive license": "upl",
    "blue oak model license": "blueoak", "mulan permissive software license": "mulanpsl", "open font license": "ofl", "latex project public license": "lppl", "q public license": "qpl",
    "cecill free software license": "cecill", "vim license": "vim", "json license": "json", "fair license": "fair", "beer ware license": "beerware", "beerware license": "beerware",
    "do what the fuck you want to public license": "wtfpl", "the unlicense": "unlicense", "free and unencumbered software released into the public domain": "unlicense",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd 4 clause": "bsd", "bsd zero clause license": "0bsd", "zero clause bsd license": "0bsd", "mit no attribution": "mit-0",
    "creative commons zero": "cc0", "cc0 1 0": "cc0", "creative commons attribution": "cc-by", "cc by 4 0": "cc-by", "cc by 3 0": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "cc by sa": "cc-by-sa", "creative commons attribution noderivatives": "cc-by-nd", "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "cc by nc": "cc-by-nc", "open database license": "odbl",
    "open data commons attribution license": "odc-by", "public domain dedication": "public-domain", "public domain": "public-domain", "server side public license": "sspl",
    "business source license": "busl", "elastic license": "elastic", "commons clause": "commons-clause", "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
# What an identifier or an expression follows.
TAGS = ("spdx license identifier", "license expression", "licence expression")
#: These are tags where a colon or an equals sign comes next, or an at sign stands before.
FIELDS = ("license", "licence", "licenses", "licences")
LEADS = tuple(f"{verb} under{the}" for verb in ("licensed", "licenced", "released", "distributed", "available", "published") for the in ("", " the", " the terms of the"))

# How freely text under a licence may be used, from 0 to 1.
FREEDOM = {
    "mit": 1.0, "mit-0": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "libpng": 1.0, "x11": 1.0,
    "postgresql": 1.0, "ncsa": 1.0, "psf": 1.0, "upl": 1.0, "blueoak": 1.0, "wtfpl": 1.0, "mulanpsl": 1.0, "fair": 1.0, "beerware": 1.0, "zpl": 1.0, "php": 0.9, "ruby": 0.9, "w3c": 0.9,
    "openssl": 0.9, "ecl": 0.9, "afl": 0.9, "vim": 0.9, "cc-by": 0.9, "odc-by": 0.9, "ofl": 0.8, "artistic": 0.8, "lppl": 0.8, "json": 0.8, "ms-pl": 0.7, "mpl": 0.7, "cddl": 0.6, "epl": 0.6,
    "cpl": 0.6, "ipl": 0.6, "spl": 0.6, "apsl": 0.6, "ms-rl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.6, "odbl": 0.6, "eupl": 0.5, "osl": 0.5, "qpl": 0.5, "cecill": 0.5, "gfdl": 0.4, "gpl": 0.4,
    "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "sspl": 0.2, "busl": 0.2, "elastic": 0.2, "commons-clause": 0.2, "reserved": 0.0,
}
UNKNOWN = 0.5
_BINDS = {"with": 3, "and": 2, "or": 1}
_SIGNS = {"/": "or", "&": "and", "|": "or"}
_FAMILIES = sorted(FREEDOM, key=len, reverse=True)
# A line break is read with the comment sign that the next line may begin with.
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-:]+|\n[ \t]*(?:[#*;%/]+|--+)?|[^ \t\r]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def label_of(identifier: str) -> str:
    """The family of a licence identifier: ``GPL-3.0-only`` is ``gpl``."""
    name = identifier.lower().rstrip("+.:")
    for family in _FAMILIES:
        if name == family or name.startswith(f"{family}-"):
            return family
    return name


def read_expression(text: str, at: int = 0) -> tuple[list[str], int]:
    """Shunting-yard: the licence expression at ``at`` in postfix order, and where it ends.

    ``with`` binds closest, then ``and``, then ``or``.  Reading stops at the first
    token that cannot continue the expression (a slash means ``or``), and at the end of a line unless a
    bracket is open or an operator still wants its right side.  Unclosed brackets
    are closed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # one is expected
    end = at
    for m in _TOKEN.finditer(text, at):
        t = m[0]
        low = _SIGNS.get(t, t.lower())
        if t[0] == "\n":
            if stack and (operand or "(" in stack):
                continue
            break
        if t == "(" and operand:
            stack.append(t)
        elif t == ")" and not operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _BINDS and not operand:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif operand and low not in _BINDS and t[0].isascii() and t[0].isalnum():
            out.append(t)
            operand = False
        else:
            break
        end = m.end()
    if operand:  # an operator without its right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out, end


def to_postfix(expression: str) -> list[str]:
    """The postfix order of the expression that a text begins with."""
    return read_expression(expression)[0]


def evaluate(postfix: list[str]) -> tuple[float, set[str]] | None:
    """Freedom and labels: ``or`` lets one choose the freer, ``and`` binds to both, ``with`` loosens a little."""
    stack: list[tuple[float, set[str]]] = []
    for t in postfix:
        if t in _BINDS:
            if len(stack) < 2:
                return None
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append((min(1.0, a[0] + 0.1), a[1]))
            else:
                stack.append(((max if t == "or" else min)(a[0], b[0]), a[1] | b[1]))
        else:
            label = label_of(t)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
    return stack[0] if len(stack) == 1 else None


def build_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    other = {p.replace("license", "licence"): label for p, label in (BASE | NOTICES).items() if "license" in p}
    for phrase, label in (other | NOTICES | BASE).items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, phrase in BASE))
    for kind, phrases in enumerate((TAGS, FIELDS, LEADS)):
        for phrase in phrases:
            a.add_word(f" {phrase} ", (phrase.count(" ") + 1, None, kind))
    a.make_automaton()
    return a


def longest(hits: list[tuple[int, int, str]]) -> list[str]:
    """Labels of the notices that do not lie inside a longer one."""
    out, reach = [], -1
    for start, end, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if end > reach:
            out.append(label)
            reach = end
    return out


def scan(text: str | None, automaton: ahocorasick.Automaton) -> dict:
    """Counts, word places, labels and score of one text."""
    text = text or ""
    words = plain_words(text.encode("utf-8", "surrogatepass"))
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, hits, tags = [], set(), [], []
    at = number = 0
    for end, (n, label, counted) in automaton.iter(line):
        number += line.count(" ", at, end)
        at = end
        if label is None:
            tags.append((number, counted))  # the word after the tag, and its kind
            continue
        hits.append((number - n, number, label))
        if counted:
            places.append(number - n)
            base.add(label)
    decisive = longest(hits)
    labels = base | set(decisive)
    terms = [FREEDOM[label] for label in decisive]
    expressions = []
    if tags:
        spans = [m.span() for m in _WORD.finditer(text)]
        for k, kind in tags:
            start = spans[k - 1][1]
            while start < len(text) and text[start] in " \t\"'`<":
                start += 1
            marked = text[start : start + 1] in (":", "=") or text[max(0, spans[k - 1][0] - 1) : spans[k - 1][0]] == "@"
            if kind == 1 and not marked:
                continue
            while start < len(text) and text[start] in " \t:=\"'`<[":
                start += 1
            postfix, end = read_expression(text, start)
            if kind and not (postfix and label_of(postfix[0]) in FREEDOM):
                continue  # prose after a word that is a tag only at times
            got = evaluate(postfix)
            if got is not None:
                terms.append(got[0])
                labels |= got[1]
                expressions.append(text[start:end].strip())
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "expressions": expressions, "score": min(terms, default=0.0),
    }


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with the licences its whole text names.

    ``score`` is how freely the text may be used: the least free of all notices
    and of the evaluated expressions after identifier tags, 0 where none is named.
    A notice inside a longer one counts as a base place, but the longer one decides
    the score: a lesser general public licence is not scored as a general one.
    Tags are ``TAGS``; fields like ``License:`` or ``@license`` and leads like
    ``licensed under the`` count where a known identifier follows.

    * A null text counts as empty: no words, no places, empty label strings.
    * Places are word numbers from 0; a phrase that stands several times, or in a
      repeated row, counts each time.
    * Other columns are not read; an empty table gives no rows.
    """
    key = new_key()

    def work(c):
        automaton = built_once(key, build_automaton)
        found = [scan(t, automaton) for t in c["text"]]
        return {"doc_id": c["doc_id"], "th": c["th"]} | {k: [f[k] for f in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score")}

    return map_batches(keyed(docs), work, "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double")
