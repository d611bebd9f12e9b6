"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Rules that reject are grown one condition at a time on two thirds of the labelled rows, pruned on the other third, and
kept while they hold there; each rule removes what it covers before the next is grown. The list becomes one ordered
Spark conditional expression over counts of the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import splitmix, utf8

#: Labelled rows that the list is learned from, at most: those with the smallest hash of their id.
SAMPLE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_block_distinct")
BASE = COUNTS[:5]
WINDOW = 8
#: Distinct words are counted block by block: over a whole text their share falls with its length.
BLOCK = 100

_SYMBOLS = list(b"#*$%&|<>")
_UPPER, _DIGITS, _MARKS, _STOPS, _BLANK = range(65, 91), range(48, 58), list(b"!?"), list(b".,;:"), [*range(9, 14), 32]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 8-word windows that occur twice or more, the first occurrence included; and words distinct in their block."""
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(x):
        return 0, len(x)
    distinct = len(np.unique(np.arange(len(x)) // BLOCK * len(ids) + x.astype(np.int64)))
    if len(x) <= WINDOW:
        return 0, distinct
    h, factor = splitmix(x + np.uint64(1)), 0x9E3779B97F4A7C15
    for step in (1, 2, 4):  # windows of 2, 4 and 8 words
        h = h[:-step] + h[step:] * np.uint64(factor)
        factor = factor * factor % 2**64
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(x) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum()), distinct


def count(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    points = int(by_byte[:128].sum() + by_byte[192:].sum())
    of = lambda group: int(by_byte[group].sum())
    repeated, distinct = repeated_words(words)
    return (
        len(words), points - of(_BLANK), of(_SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), of(_UPPER), of(_DIGITS), of(_MARKS), of(_STOPS), distinct,
    )


def _counts_of(texts: pa.Array) -> pa.Array:
    table = np.array([count(t) for t in utf8(texts)], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))


def counts(text: Column) -> Column:
    """A struct of COUNTS; null and empty texts count 0 everywhere."""
    schema = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    return F.arrow_udf(_counts_of, schema).asNondeterministic()(text)  # so marked, it is worked out once


def base_failed(c: Column) -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


#: What rules look at: a count over another, by name.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "digits_per_word": ("n_digits", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_block_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(c: Column, name: str) -> Column:
    top, bottom = RATIOS[name]
    return c[top] / F.greatest(c[bottom], F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, c: Column) -> Column:
        v = feature(c, self.feature)
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """The condition of the largest gain: bad rows kept, times the bits that their share grows by."""
    best, found, prior = 0.0, None, np.log2(max(bad.mean(), 1e-12))
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        value, p = v[order], np.cumsum(bad[order])
        at = np.flatnonzero(value[1:] > value[:-1])
        if len(at) > cuts:
            at = at[np.linspace(0, len(at) - 1, cuts).astype(int)]
        for above in (False, True):
            good_p = p[-1] - p[at] if above else p[at]
            all_n = len(v) - 1 - at if above else at + 1
            gain = good_p * (np.log2(np.maximum(good_p, 1e-12) / all_n) - prior)
            if len(gain) and gain.max() > best + 1e-9:
                k = int(gain.argmax())
                best, found = float(gain[k]), Condition(name, above, float((value[at[k]] + value[at[k] + 1]) / 2))
    return best, found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, conditions: int = 4, rules: int = 12, cuts: int = 256) -> list[Rule]:
    """Rules that reject, in order. Every third row is for pruning; rows must come in no order that matters."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, found = np.ones(n, bool), []
    while len(found) < rules and (bad & left & ~prune).any():
        rule: Rule = ()
        while len(rule) < conditions:
            here = left & ~prune & _covered(rule, x, n)
            if not (here & ~bad).any():
                break
            _, c = _best_condition({k: v[here] for k, v in x.items()}, bad[here], cuts)
            if c is None:
                break
            rule = (*rule, c)

        def worth(r: Rule, left: np.ndarray = left) -> float:
            hit = left & prune & _covered(r, x, n)
            p, k = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - k) / (p + k) if p + k else -1.0

        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: (worth(r), -len(r)))
        if (worth(rule) + 1) / 2 < precision:
            break
        found.append(rule)
        left &= ~_covered(rule, x, n)
    return found


def expression(c: Column, rules: Sequence[Rule]) -> Column:
    """The first rule that holds, as text; null if none does. ``c`` is a struct of COUNTS."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = rule[0].column(c)
        for more in rule[1:]:
            holds = holds & more.column(c)
        out = F.when(holds, " and ".join(map(str, rule))).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **options) -> list[Rule]:
    """Learn from documents with a label (doc_id, quality: 0 is bad); a document with several counts as bad if one says so.

    The sample is bounded by ``sample`` rows, so it may be broadcast and its statistics brought to the driver.
    """
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", counts(F.col("text")).alias("c"))
    rows = rows.select("doc_id", (F.col("quality") == 0).alias("bad"), *(feature(F.col("c"), f).alias(f) for f in RATIOS))
    # an id may have many rows; the least statistics stand for it
    got = rows.groupBy("doc_id").agg(F.min(F.struct("bad", *RATIOS)).alias("r")).select("doc_id", "r.*").toPandas()
    got = got.iloc[np.argsort(splitmix(got["doc_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")]
    return learn({f: got[f].to_numpy(np.float64) for f in RATIOS}, got["bad"].to_numpy(bool), **options) if len(got) else []


def judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``counts``, ``base_failed``, ``rule`` (the first that rejects, or null) and ``kept``.

    docs: text and any other columns; columns named like those added are replaced. Null and empty texts have no words
    and fail. Every row is judged by itself, so repeated rows get equal results.
    """
    out = docs.drop("counts", "base_failed", "rule", "kept").withColumn("counts", counts(F.col("text")))
    out = out.withColumns({"base_failed": base_failed(F.col("counts")), "rule": expression(F.col("counts"), rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
