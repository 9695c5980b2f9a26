"""Quality rules as a learned decision list.

Sequential covering: rules that find bad documents are grown one threshold at a time on two thirds
of the labelled rows, pruned on the other third, and kept while they are precise there. The list
becomes one ordered CASE expression over text statistics, so judging a corpus is one scan.

Statistics are taken from whole texts. A null text counts as no words. A document that no rule
matches is good. Labels that contradict each other for a document, or are null, take no part.
Repeated rows are judged alike. Without usable labels only the base rules hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import free_name, written

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks",
)
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
# What rules may test, as ratios of the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "coalesce(word_chars / n_words, 0D)",
    "symbols": "coalesce(n_symbols / n_words, 0D)",
    "dup_lines": "coalesce(n_dup_lines / n_lines, 0D)",
    "repeats": "coalesce(n_repeat_words / n_words, 0D)",
    "upper": "coalesce(n_upper / word_chars, 0D)",
    "digits": "coalesce(n_digits / word_chars, 0D)",
    "marks": "coalesce(n_marks / n_words, 0D)",
}
MAX_LABELLED = 20_000
MIN_PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 16
MAX_CONDITIONS = 4
CUTS = 256

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size == n:
        return 0
    pair = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:  # the product of three would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII spaces only
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    plain = len(data)
    spaces = plain - len(data.translate(None, _SPACES))
    return (
        len(words),
        len(text) - spaces,
        plain - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        plain - len(data.translate(None, _UPPER)),
        plain - len(data.translate(None, b"0123456789")),
        data.count(b"!") + data.count(b"?"),
    )


@F.arrow_udf(STATS_TYPE)
def text_stats(text: pa.Array) -> pa.Array:
    rows = [text_counts(t.as_py()) for t in text]
    columns = list(zip(*rows)) or [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and, behind them, the struct `stats`; a column called so stays."""
    return docs.select("*", text_stats(F.col(text)).alias(free_name(docs, "stats")))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def test(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, columns: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for condition in rule:
        rows = rows & condition.test(columns)
    return rows


def _best_condition(columns, bad, rows) -> Condition | None:
    """The threshold with the largest information gain on the covered rows."""
    p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
    if not p0 or not n0:
        return None
    prior = np.log2(p0 / (p0 + n0))
    best, best_gain = None, 1e-9
    for name, values in columns.items():
        own, own_bad = values[rows], bad[rows]
        cuts = np.unique(own)
        if len(cuts) > CUTS:
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS), method="lower"))
        order = np.argsort(own, kind="stable")
        below_all = np.searchsorted(own[order], cuts, side="right")
        after = own[order][np.minimum(below_all, len(own) - 1)]
        bad_before = np.concatenate([[0], np.cumsum(own_bad[order])])
        p_low = bad_before[below_all]
        for above, p, total in ((False, p_low, below_all), (True, p0 - p_low, p0 + n0 - below_all)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((p > 0) & (total > 0), p * (np.log2(p / total) - prior), 0)
            i = int(np.argmax(gain))
            if gain[i] > best_gain:
                # Halfway to the next value seen: as far from either side as the rows allow.
                middle = float(cuts[i] + (after[i] - cuts[i]) / 2)
                best, best_gain = Condition(name, above, middle), gain[i]
    return best


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows, on numpy columns of the bounded sample."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        rows = left & grow
        while len(rule) < MAX_CONDITIONS:
            condition = _best_condition(columns, bad, rows)
            if condition is None:
                break
            rule += (condition,)
            rows = rows & condition.test(columns)
        # Prune: the shortest beginning that is worth most on rows it was not grown on.
        worth = []
        for n in range(1, len(rule) + 1):
            hit = _covered(rule[:n], columns, left & ~grow)
            p, total = int((hit & bad).sum()), int(hit.sum())
            worth.append(((2 * p - total) / total if total else -1.0, -n))
        if not worth:
            break
        rule = rule[: -max(worth)[1]]
        held = _covered(rule, columns, left & ~grow)
        both = _covered(rule, columns, left)
        if (held & bad).sum() < MIN_COVER or not all(
            (hit & bad).sum() >= MIN_PRECISION * hit.sum() for hit in (held, both)
        ):
            break
        rules.append(rule)
        left &= ~both
    return rules


def train(counts: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn from the labelled documents; at most `max_labelled` of them, by a seeded hash.

    `counts` has doc_id and COUNTS, `labels` doc_id and quality (0 bad, 1 good).
    """
    agreed = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high")
        .select(F.col("doc_id").alias("_labelled"), (F.col("_low") == 0).alias("_bad"))
    )
    labelled = written(
        counts.where(~base_failed())
        .join(agreed, F.col("doc_id") == F.col("_labelled"))
        .select(
            F.xxhash64("doc_id", F.lit("grow")).alias("_at"),
            "_bad",
            *[F.expr(e).alias(f) for f, e in FEATURES.items()],
        ),
        "labelled",
    )
    # By hash a little more than the sample, so that only about as much is sorted and moved.
    share = min(1.0, 1.2 * max_labelled / max(1, labelled.count()))
    sample = (
        labelled.where(F.pmod("_at", F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
        .orderBy("_at", *FEATURES, "_bad")
        .limit(max_labelled)
        .toPandas()
    )
    if sample.empty:
        return []
    columns = {f: sample[f].to_numpy(float) for f in FEATURES}
    return learn(columns, sample["_bad"].to_numpy(bool), sample["_at"].to_numpy() % 3 != 0)


def verdict(rules: list[Rule]) -> Column:
    """True for good: the ordered rules as one conditional expression over COUNTS."""
    out = None
    for rule in rules:
        met = F.expr(" and ".join(f"({c.sql()})" for c in rule))
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept to rows that have COUNTS; columns called so stay."""
    failed, kept = (free_name(counts, n) for n in ("base_failed", "kept"))
    return counts.select("*", base_failed().alias(failed), (~base_failed() & verdict(rules)).alias(kept))
