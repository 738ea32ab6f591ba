"""License scan: one Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates the tags' expressions.

Words are lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; a phrase stands wherever its words are consecutive words of the text. Base phrases give the
labels cc-by, gpl and reserved; further phrases and the licences of identifier tags add labels of their own, which are lower-cased identifiers.

`score` tells how restrictive the strictest statement is, 0 (none) to 1 (all rights reserved). In an expression, `or` takes the milder side, `and` the
stricter one, and `with` (an exception) lowers a strong copyleft to a weak one; a tag that isn't an expression is as strict as an unknown licence.

Defined cases: a NULL or empty text has no words, no places, empty labels and score 0; repeated rows each get their own answer. The scan needs no
shuffle, and its state is the fixed phrase list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinelake.llm.words import ALNUM, Words, ragged, text_slices

# Phrases that the result counts as base places, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices and their labels.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
    "creative commons attribution": "cc-by", "isc license": "isc", "unlicense": "unlicense",
}
TAG = "spdx license identifier"
# How restrictive a family is; the longest prefix of an identifier counts.
STRICT = {
    "cc0": 0.1, "public-domain": 0.1, "unlicense": 0.1, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "apache": 0.2, "cc-by": 0.3, "cc-by-sa": 0.6, "mpl": 0.5,
    "lgpl": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.9, "cc-by-nd": 0.9, "reserved": 1.0,
}
UNKNOWN, WEAK, STRONG = 0.6, 0.5, 0.7
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_LEVEL = {"or": 1, "and": 2, "with": 3}

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_tags", pa.int64()), ("n_broken_tags", pa.int64()),
])
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, n_broken_tags long"


def strictness(label: str) -> float:
    names = [k for k in STRICT if label == k or label.startswith((f"{k}-", f"{k}+"))]
    return STRICT[max(names, key=len)] if names else UNKNOWN


def to_postfix(expression: str) -> list[str] | None:
    """Operands and operators of a licence expression in postfix order; None if it isn't one. It ends before the first token that can't continue it, or with a full stop."""
    out, held, operand_next = [], [], True
    for found in _TOKEN.finditer(expression):
        token = found.group()
        low = token.lower().rstrip(".:-")
        if (low in _LEVEL or token == ")") if operand_next else low not in _LEVEL and (token != ")" or "(" not in held):
            break
        if low in _LEVEL:
            while held and held[-1] != "(" and _LEVEL[held[-1]] >= _LEVEL[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(low)
            operand_next = False
            if token.endswith("."):
                break
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Licences named in the expression and how restrictive it is as a whole; None if it can't be parsed."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _LEVEL:
            stack.append(({token}, strictness(token)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":  # the exception's name is no licence
            stack.append((left, WEAK if a >= STRONG and a < 0.9 else a))
        else:
            stack.append((left | right, min(a, b) if token == "or" else max(a, b)))
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: None}:
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def _joined(words: Words) -> tuple[str, np.ndarray]:
    """All words with one blank around each, as ASCII (other bytes as \\x01), and where each word begins."""
    size = words.end - words.start
    at = np.cumsum(size + 1) - size
    out = np.full(int((size + 1).sum()) + 1, 32, np.uint8)
    source = words.low[ragged(words.start, size)]
    out[ragged(at, size)] = np.where(source < 128, source, 1)
    return out.tobytes().decode("ascii"), at


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in text_slices(batches):
        words = Words(batch.column("text"), ALNUM)
        text, at = _joined(words)
        of, n = words.doc(), batch.num_rows
        places: dict[int, list[int]] = {}
        base: dict[int, set[str]] = {}
        labels: dict[int, set[str]] = {}
        score, tags, broken = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for stop, (phrase, size) in automaton.iter(text):
            w = int(np.searchsorted(at, stop - len(phrase)))
            d = int(of[w])
            if of[w + size - 1] != d:
                continue
            if phrase == TAG:
                line = words.raw[words.end[w + size - 1] : words.text_at[d + 1]].tobytes().split(b"\n", 1)[0].decode(errors="replace")
                tags[d] += 1
                if (value := evaluate(line)) is None:
                    broken[d] += 1
                    names, strict = set(), UNKNOWN
                else:
                    names, strict = value
                labels.setdefault(d, set()).update(names)
            else:
                label = BASE.get(phrase) or NOTICES[phrase]
                if phrase in BASE:
                    places.setdefault(d, []).append(w - int(words.first[d]))
                    base.setdefault(d, set()).add(label)
                labels.setdefault(d, set()).add(label)
                strict = strictness(label)
            score[d] = max(score[d], strict)
        said = lambda of: pa.array([",".join(sorted(of.get(i, ()))) for i in range(n)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), pa.array(words.counts.astype(np.int64)), pa.array([len(places.get(i, ())) for i in range(n)], pa.int64()),
                pa.array([min(places[i]) if i in places else None for i in range(n)], pa.int64()), pa.array([max(places[i]) if i in places else None for i in range(n)], pa.int64()),
                said(base), said(labels), pa.array(score), pa.array(tags), pa.array(broken),
            ],
            schema=SCHEMA,
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, n_broken_tags."""
    return docs.select("doc_id", "text").mapInArrow(_scan, RESULT)
