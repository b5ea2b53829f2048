"""Rule packs and the compiler that turns them into Catalyst columns.

A pack is data: an ordered list of labelled rules.  A rule hits when one of its
``substr`` / ``word`` / ``regex`` patterns occurs (or one of its ``flags`` columns is
true, or one of its ``topics`` is among the row's), every group in ``all_of``, every
pattern in ``all_regex`` and every column in ``all_flags`` holds, and nothing in
``none_of`` / ``none_flags`` does.  Text columns are expected to be lower-cased once,
ahead of the rules.
"""

from __future__ import annotations

import functools
import re
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.functions import automaton
from tidemark.functions.text import compact

PACK_DIR = Path(__file__).resolve().parent.parent / "packs"


@dataclass(frozen=True)
class Rule:
    label: str
    substr: tuple[str, ...] = ()
    word: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    all_of: tuple[tuple[str, ...], ...] = ()
    all_regex: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    all_flags: tuple[str, ...] = ()
    none_flags: tuple[str, ...] = ()
    weight: float = 1.0
    attrs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    @staticmethod
    def words(name: str, terms: Iterable[str]) -> "Pack":
        return Pack(name, tuple(Rule(t, substr=(t,)) for t in terms))

    @staticmethod
    def whole_words(name: str, terms: Iterable[str]) -> "Pack":
        return Pack(name, tuple(Rule(t, word=(t,)) for t in terms))

    @staticmethod
    def weighted(name: str, weights: dict[str, float]) -> "Pack":
        return Pack(name, tuple(Rule(t, substr=(t,), weight=float(w)) for t, w in weights.items()))

    @staticmethod
    def of(name: str, rows: Iterable[dict]) -> "Pack":
        return Pack(name, tuple(_rule(r) for r in rows))

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys(r.label for r in self.rules))


def _rule(row: dict) -> Rule:
    lists = ("substr", "word", "regex", "all_regex", "none_of", "flags", "topics", "all_flags", "none_flags")
    known = {"label", "all_of", "weight", *lists}
    return Rule(
        label=row["label"],
        all_of=tuple(tuple(g) for g in row.get("all_of", ())),
        weight=float(row.get("weight", 1.0)),
        attrs=tuple((k, str(v)) for k, v in row.items() if k not in known),
        **{k: tuple(row.get(k, ())) for k in lists},
    )


@cache
def load_packs(name: str = "marketplace") -> dict[str, Pack]:
    """Read ``packs/<name>.toml`` (or any path) into packs.

    A list of strings is a word list, a table of numbers a weighted list, a table of
    lists one label per key, a list of tables an ordered set of labelled rules, a lone
    string one regex.
    """
    path = Path(name)
    if path.suffix != ".toml":
        path = PACK_DIR / f"{name}.toml"
    packs: dict[str, Pack] = {}
    for key, value in tomllib.loads(path.read_text(encoding="utf-8")).items():
        if isinstance(value, str):
            packs[key] = Pack(key, (Rule(key, regex=(value,)),))
        elif isinstance(value, dict) and all(isinstance(v, list) for v in value.values()):
            packs[key] = Pack(key, tuple(Rule(k, substr=tuple(v)) for k, v in value.items()))
        elif isinstance(value, dict):
            packs[key] = Pack.weighted(key, value)
        elif value and isinstance(value[0], dict):
            packs[key] = Pack.of(key, value)
        else:
            packs[key] = Pack.words(key, value)
    return packs


# --- pattern -> Column ----------------------------------------------------------

def _balanced(cols: Sequence[Column], op) -> Column:
    cols = list(cols)
    while len(cols) > 1:
        cols = [op(cols[i], cols[i + 1]) if i + 1 < len(cols) else cols[i] for i in range(0, len(cols), 2)]
    return cols[0]


def any_of(cols: Sequence[Column]) -> Column:
    return _balanced(cols, lambda a, b: a | b) if cols else F.lit(False)


def all_true(cols: Sequence[Column]) -> Column:
    return _balanced(cols, lambda a, b: a & b) if cols else F.lit(True)


def total(cols: Sequence[Column]) -> Column:
    return _balanced(cols, lambda a, b: a + b) if cols else F.lit(0)


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Literal substrings: a balanced OR of ``contains``, which stays in codegen."""
    return any_of([text.contains(t) for t in dict.fromkeys(terms)])


def word_regex(terms: Iterable[str]) -> str:
    return r"\b(?:" + "|".join(_quote(t) for t in dict.fromkeys(terms)) + r")\b"


def _quote(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def contains_word(text: Column, terms: Iterable[str]) -> Column:
    """Whole words. A cheap search for their letters decides which rows need the pattern."""
    terms = list(terms)
    hit = text.rlike("(?U)" + word_regex(terms))
    return contains_any(text, terms) & hit if terms else hit


def matches(text: Column, pattern: str) -> Column:
    """Unicode-aware, case-blind regex search."""
    return text.rlike("(?iU)" + pattern)


def rule_hit(text: Column, rule: Rule, topics: Column | None = None) -> Column:
    positive: list[Column] = [F.coalesce(F.col(f), F.lit(False)) for f in rule.flags]
    if rule.substr:
        positive.append(contains_any(text, rule.substr))
    if rule.word:
        positive.append(contains_word(text, rule.word))
    if rule.regex:
        positive.append(matches(text, "(?:" + "|".join(rule.regex) + ")"))
    if rule.topics and topics is not None:
        positive.append(F.arrays_overlap(topics, F.array(*[F.lit(t) for t in rule.topics])))
    parts = [any_of(positive)] if positive else []
    parts += [contains_any(text, group) for group in rule.all_of]
    parts += [matches(text, p) for p in rule.all_regex]
    parts += [F.coalesce(F.col(f), F.lit(False)) for f in rule.all_flags]
    if rule.none_of:
        parts.append(~contains_any(text, rule.none_of))
    parts += [~F.coalesce(F.col(f), F.lit(False)) for f in rule.none_flags]
    return all_true(parts)


def terms_of(pack: Pack) -> list[str]:
    """The plain substrings of a pack."""
    return [t for r in pack.rules for t in r.substr]


def fence(c: Column) -> Column:
    """The same value behind an always-true test on a random number.

    Catalyst derives constraints from every deterministic alias and pushes filters on a label
    through the projection that computes it.  For long cascades over many flags both copy
    the expressions again and again and planning takes minutes.  A non-deterministic column
    takes part in neither.  Filters on plain columns stop here too, so apply those first.
    """
    return F.when(F.rand(0) >= 0, c)


def fenced(cols: dict[str, Column]) -> dict[str, Column]:
    return {k: fence(c) for k, c in cols.items()}


def flag_columns(text: Column, pack: Pack, topics: Column | None = None, absent: frozenset[str] = frozenset()) -> dict[str, Column]:
    """One boolean column per label; rules with the same label are alternatives.

    Flags in ``absent`` are columns the table lacks: they never hit.
    """
    grouped: dict[str, list[Rule]] = {}
    for r in pack.rules:
        kept = replace(r, flags=tuple(f for f in r.flags if f not in absent))
        if r.flags and not (kept.flags or kept.substr or kept.word or kept.regex or kept.topics):
            kept = replace(r, flags=(), regex=("(?!)",))  # nothing left that could hit
        grouped.setdefault(r.label, []).append(kept)
    return {label: any_of([rule_hit(text, r, topics) for r in rs]) for label, rs in grouped.items()}


# --- the five modes --------------------------------------------------------------

def any_hit(text: Column, pack: Pack) -> Column:
    """True when any rule of the pack hits.  Plain substring packs fold into one OR."""
    plain = [r for r in pack.rules if r == Rule(r.label, substr=r.substr, weight=r.weight, attrs=r.attrs)]
    words = [r for r in pack.rules if r == Rule(r.label, word=r.word, weight=r.weight, attrs=r.attrs)]
    rest = [r for r in pack.rules if r not in plain and r not in words]
    parts = []
    if plain:
        parts.append(contains_any(text, [t for r in plain for t in r.substr]))
    if words:
        parts.append(contains_word(text, [t for r in words for t in r.word]))
    return any_of(parts + [rule_hit(text, r) for r in rest])


def sum_hits(text: Column, pack: Pack, weighted: bool = False) -> Column:
    """Number of rules that hit, or the sum of their weights."""
    kind = "double" if weighted else "int"
    hits = [rule_hit(text, r).cast(kind) * (F.lit(r.weight) if weighted else F.lit(1)) for r in pack.rules]
    return total(hits)


def first_label(text: Column, pack: Pack, default: str | None = None, topics: Column | None = None) -> Column:
    """Label of the first rule that hits, in pack order."""
    if not pack.rules:
        return F.lit(default)
    out = None
    for rule in pack.rules:
        hit = rule_hit(text, rule, topics)
        out = F.when(hit, rule.label) if out is None else out.when(hit, rule.label)
    return out.otherwise(F.lit(default))


def all_labels(text: Column, pack: Pack, sort: bool = False, default: str | None = None) -> Column:
    """Array of every label that hits, in pack order or sorted.

    A large pack is looked for in one pass (``candidates``); rules with patterns then test only the rows that can hit.
    """
    grouped: dict[str, list[Rule]] = {}
    for r in pack.rules:
        grouped.setdefault(r.label, []).append(r)
    if not _in_one_pass(pack):
        flags = [F.when(any_of([rule_hit(text, r) for r in rs]), F.lit(label)) for label, rs in grouped.items()]
        arr = compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    elif not any(map(_has_pattern, pack.rules)):
        arr = F.coalesce(candidates(text, pack, labels=True), F.array().cast("array<string>"))
    else:
        can, at = candidates(text, pack), {id(r): i for i, r in enumerate(pack.rules)}
        sure = lambda r: F.array_contains(can, F.lit(at[id(r)]))
        hit = lambda r: F.when(sure(r), rule_hit(text, r)) if _has_pattern(r) else sure(r)
        arr = compact(F.array(*[F.when(any_of([hit(r) for r in rs]), F.lit(label)) for label, rs in grouped.items()]))
    if sort:
        arr = F.array_sort(arr)
    if default is not None:
        arr = F.when(F.size(arr) == 0, F.array(F.lit(default))).otherwise(arr)
    return arr


#: From this many terms on, one pass of an automaton is cheaper than a search for each.
ONE_PASS_TERMS = 24


def _has_pattern(r: Rule) -> bool:
    return bool(r.word or r.regex or r.all_regex)


def _terms(r: Rule) -> list[str]:
    return [*r.substr, *r.word, *r.none_of, *(t for group in r.all_of for t in group)]


def _in_one_pass(pack: Pack) -> bool:
    """Whether the rules look at the text alone and are many, or hold patterns."""
    terms = [t for r in pack.rules for t in _terms(r)]
    plain = all(terms) and all(_terms(r) or r.regex or r.all_regex for r in pack.rules)
    plain = plain and not any(r.flags or r.topics or r.all_flags or r.none_flags for r in pack.rules)
    return plain and (len(set(terms)) >= ONE_PASS_TERMS or any(r.regex or r.all_regex for r in pack.rules))


_machine = functools.lru_cache(maxsize=64)(lambda terms: automaton.build(terms))


def candidates(text: Column, pack: Pack, labels: bool = False) -> Column:
    """Numbers of the rules that can hit, ascending; null for null. Rules of plain terms do hit; of the others, words may lie inside longer ones
    and patterns are those of another engine (see ``_can_match``). ``labels`` gives the distinct labels in pack order instead."""
    rules, terms = pack.rules, tuple(sorted({t for r in pack.rules for t in _terms(r)}))
    names = pack.labels if labels else []

    @arrow_udf("array<string>" if labels else "array<int>")
    def find(texts: pa.Array) -> pa.Array:
        return can_hit(texts, rules, terms, names)

    return find(text)


def can_hit(texts: pa.Array, rules: Sequence[Rule], terms: tuple[str, ...], names: list[str]) -> pa.Array:
    number = {t: i for i, t in enumerate(terms)}
    has = np.zeros((max(len(terms), 1), len(texts)), bool)
    if terms:
        machine = _machine(terms)
        rows, found = automaton.held(machine, texts)
        has[np.array([number[t] for t in machine.terms])[found], rows] = True
    some = lambda group: has[[number[t] for t in group]].any(0)
    odd = None
    if any(r.regex or r.all_regex for r in rules):
        # on tabs, line feeds and printable ASCII the engines agree about blanks, words, line ends and letter case
        odd = _found(texts, r"[^\t\n\x20-\x7e]")
    out = np.zeros((len(names) or len(rules), len(texts)), bool)
    for i, r in enumerate(rules):
        can = np.ones(len(texts), bool) if not (r.substr or r.word or r.regex) else np.zeros(len(texts), bool)
        if r.substr or r.word:
            can |= some((*r.substr, *r.word))
        for pattern in r.regex:
            can |= odd | _can_match(texts, pattern)
        for group in r.all_of:
            can &= some(group)
        for pattern in r.all_regex:
            can &= odd | _can_match(texts, pattern)
        if r.none_of:
            can &= ~some(r.none_of)
        out[names.index(r.label) if names else i] |= can
    if texts.null_count:
        out[:, np.asarray(texts.is_null().to_numpy(zero_copy_only=False), bool)] = False
    rows, hits = np.nonzero(out.T)
    return automaton.listed(texts, rows, hits, pa.array(names, pa.string()) if names else pa.array(np.arange(len(rules), dtype=np.int32)))


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    hit = pc.match_substring_regex(texts, pattern)
    return np.asarray(pc.fill_null(hit, False).to_numpy(zero_copy_only=False), bool)


def _can_match(texts: pa.Array, pattern: str) -> np.ndarray:
    """Texts that RE2, in linear time, finds the pattern in; all of them where its reading of the pattern could be another."""
    bare = re.sub(r"\\.", "x", pattern)
    if "$" in bare or "&&" in bare or re.search(r"\[[^\]]*\[", bare) or "\\v" in pattern or "(?" in bare.replace("(?:", ""):
        return np.ones(len(texts), bool)
    try:
        return _found(texts, f"(?i)(?:{pattern})")
    except pa.ArrowInvalid:  # not a pattern of RE2
        return np.ones(len(texts), bool)


def label_counts(text: Column, pack: Pack) -> Column:
    """Array of ``(hits, -priority, label)``; hits counts the patterns of a label's rules."""
    out = []
    for i, rule in enumerate(pack.rules):
        tests = [text.contains(t).cast("int") for t in dict.fromkeys(rule.substr)]
        tests += [contains_word(text, [t]).cast("int") for t in dict.fromkeys(rule.word)]
        tests += [matches(text, p).cast("int") for p in rule.regex]
        out.append(F.struct(total(tests).alias("hits"), F.lit(-i).alias("prio"), F.lit(rule.label).alias("label")))
    return F.array(*out)


def best_label(text: Column, pack: Pack, default: str | None = None) -> Column:
    """Label with the most pattern hits; the earliest rule wins ties."""
    best = F.array_max(label_counts(text, pack))
    return F.when(best["hits"] > 0, best["label"]).otherwise(F.lit(default))


def runner_up_labels(text: Column, pack: Pack, n: int = 2) -> Column:
    """The next labels after the best one, by hits then order."""
    ranked = F.sort_array(F.filter(label_counts(text, pack), lambda s: s["hits"] > 0), asc=False)
    return F.transform(F.slice(ranked, 2, n), lambda s: s["label"])


# --- table form ------------------------------------------------------------------

def explode_hits(df: DataFrame, text_col: str, lexicon: "DataFrame | Sequence[str]", term_col: str = "term",
                 table_bytes: int = automaton.TABLE_BYTES) -> DataFrame:
    """One row per (row, lexicon term contained in the lower-cased text). Empty terms are in no text.

    One pass per part of the lexicon with an automaton of at most ``table_bytes``: a list or a table, of any size, goes the
    same way, and only hits copy their row.
    """
    text = F.lower(F.col(text_col))
    batches = automaton.parts(lexicon, term_col, table_bytes) if isinstance(lexicon, DataFrame) else [list(lexicon)]
    found = [df.withColumn(term_col, F.explode(automaton.hits(df.sparkSession, terms, text))) for terms in batches]
    return functools.reduce(DataFrame.unionByName, found)
