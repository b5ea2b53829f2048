"""All terms of a lexicon found in one pass over the texts: an automaton as flat arrays.

Every prefix of a term is a state; a row of the table gives the next state for each byte class (bytes that no term holds share
one). A state knows the term that ends there and the next shorter state in which another one does. A batch of texts is cut into
stretches that overlap by the longest term, and all stretches advance together, one table look-up per byte column.

An automaton is bounded by ``TABLE_BYTES``; a lexicon beyond it is split by a hash of the term, and its parts are matched one after
the other. So there is one plan for every size of lexicon, and no row is copied but per hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

TABLE_BYTES = 64 << 20
#: Bytes of text a task works on at once, and the length of a stretch.
SLICE, STRETCH = 4 << 20, 1024


@dataclass
class Automaton:
    terms: list[str]
    longest: int
    classes: np.ndarray  # byte -> class; 0 for bytes of no term
    step: np.ndarray  # state * n_classes + class -> state
    ends: np.ndarray  # state -> term or -1
    shorter: np.ndarray  # state -> the next shorter state at which a term ends, or -1

    @property
    def n_classes(self) -> int:
        return int(self.classes.max()) + 1


def build(terms: Iterable[str]) -> Automaton:
    """The automaton of distinct, non-empty terms."""
    terms = sorted({t for t in terms if t})
    coded = [t.encode("utf-8", "surrogatepass") for t in terms]
    classes = np.zeros(256, np.int64)
    used = sorted(set(b"".join(coded)))
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for i, term in enumerate(coded):
        at = 0
        for byte in term:
            nxt = children[at].get(byte)
            if nxt is None:
                nxt = children[at][byte] = len(children)
                children.append({})
                ends.append(-1)
            at = nxt
        ends[at] = i
    step = np.zeros((len(children), width), np.int32)
    fall = np.zeros(len(children), np.int64)
    shorter = np.full(len(children), -1, np.int64)
    level = [0]
    while level:  # breadth first: where a state falls back to is complete by then
        following = []
        for state in level:
            back = fall[state]
            if state:
                step[state] = step[back]
                shorter[state] = back if ends[back] >= 0 else shorter[back]
            for byte, child in children[state].items():
                fall[child] = step[back, classes[byte]] if state else 0
                step[state, classes[byte]] = child
                following.append(child)
        level = following
    return Automaton(terms, max(map(len, coded), default=0), classes.astype(np.uint8 if width < 256 else np.uint16), step.ravel(), np.array(ends), shorter)


def find(machine: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of all terms inside the texts that lie at ``starts``..``ends`` of the bytes ``data``; sorted, each pair once."""
    if not machine.terms:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lead = machine.longest - 1
    pieces = np.maximum(1, -(-(ends - starts) // STRETCH))
    row = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)
    stop = np.minimum(starts[row] + (nth + 1) * STRETCH, ends[row])
    begin = np.maximum(starts[row] + nth * STRETCH - lead, starts[row])
    order = np.argsort(begin - stop, kind="stable")  # longest first: finished stretches drop off at the end
    row, begin, length = row[order], begin[order], (stop - begin)[order]
    state = np.zeros(len(row), np.int64)
    width = machine.n_classes
    said = (machine.ends >= 0) | (machine.shorter >= 0)
    codes = machine.classes[data]
    rows, states = [], []
    for j in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -j, side="left"))  # stretches longer than j
        state[:live] = machine.step[state[:live] * width + codes[begin[:live] + j]]
        hit = np.flatnonzero(said[state[:live]])
        if len(hit):
            rows.append(row[hit])
            states.append(state[hit])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pair = np.unique(np.concatenate(rows) * len(machine.ends) + np.concatenate(states))
    rows, at = np.divmod(pair, len(machine.ends))
    found = []
    while len(at):
        real = machine.ends[at] >= 0
        found.append(rows[real] * len(machine.terms) + machine.ends[at[real]])
        at = machine.shorter[at]
        rows, at = rows[at >= 0], at[at >= 0]
    return np.divmod(np.unique(np.concatenate(found)), len(machine.terms))


def held(machine: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all terms inside the texts, as numbers; sorted, each pair once."""
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    where, numbers, first = [], [], 0
    while first < len(texts):  # whole texts, about SLICE bytes of them
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1)
        part = data[at[first] : at[last]]
        rows, found = find(machine, part, at[first:last] - at[first], at[first + 1 : last + 1] - at[first])
        where.append(rows + first)
        numbers.append(found)
        first = last
    return np.concatenate(where), np.concatenate(numbers)


def terms_in(machine: Automaton, texts: pa.Array) -> pa.Array:
    """Per text the list of terms it holds, in code point order; null for null."""
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    return listed(texts, *held(machine, texts), pa.array(machine.terms, pa.string()))


def listed(texts: pa.Array, rows: np.ndarray, numbers: np.ndarray, names: pa.Array) -> pa.Array:
    """Per text the names of its numbers, where ``rows`` counts up; null for null."""
    offsets = np.concatenate(([0], np.bincount(rows, minlength=len(texts)).cumsum())).astype(np.int32)
    mask = pa.array(np.asarray(texts.is_null().to_numpy(zero_copy_only=False), bool)) if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(numbers, pa.int64())), mask=mask)


def hits(spark, terms: Iterable[str], text: Column) -> Column:
    """The terms of a bounded lexicon inside ``text``, as an array."""
    shared = spark.sparkContext.broadcast(build(terms))

    @arrow_udf("array<string>")
    def match(texts: pa.Array) -> pa.Array:
        return terms_in(shared.value, texts)

    return match(text)


def parts(lexicon: DataFrame, term_col: str, table_bytes: int = TABLE_BYTES) -> Iterator[list[str]]:
    """The distinct terms of a table, in parts whose automaton stays below ``table_bytes``."""
    terms = lexicon.select(F.col(term_col).alias("t")).where(F.length(term_col) > 0).distinct()
    total = terms.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    letters = terms.select(F.explode(F.split("t", "")).alias("c")).distinct().agg(F.sum(F.octet_length("c"))).first()[0] or 0
    n = -(-total * 4 * min(256, letters + 1) // table_bytes) or 1  # a state per byte, 4 bytes per class
    for part in range(n):
        yield [r[0] for r in terms.where(F.pmod(F.xxhash64("t"), F.lit(n)) == part).collect()]
