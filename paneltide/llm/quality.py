"""Quality of whole texts by a factorisation machine over hashed words and structure.

Every pair of inputs interacts through short factor vectors. A score takes time linear in the
inputs of a text, because the sum over pairs is half of (sum of v x) squared minus the sum of
(v x) squared, per factor.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.labelled import MAX_LABELLED, fold_of, labelled_sample
from paneltide.sources.io import stage_via_parquet

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
WORD_BUCKETS = 4096
FACTORS = 6
ITERATIONS = 120
STEP = 0.1
PENALTY = 1e-4
CLIP = 4.0                # standard deviations a structure value may lie off the mean
TEXTS_AT_ONCE = 64

_SIGNS = b"#$%&*@|~^_<>=+\\{}[]/"
_END_SIGN, _WHITE = (np.isin(np.arange(256), list(chosen)) for chosen in (b"#$%&*@|~^!", b" \t\n\r\v\f"))
STRUCTURE = ("chars", "words", "word_length", "capitals", "digits", "punctuation", "signs",
             "exclamations", "white", "lines", "other_bytes", "word_kinds", "top_word",
             "line_kinds", "top_line", "sign_ends", "pair_kinds")


@dataclass(frozen=True)
class Machine:
    """Weights of the structure values followed by the word buckets, and how values are scaled."""

    mean: np.ndarray
    deviation: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray       # (inputs, FACTORS)


def _kinds(hashes: np.ndarray) -> tuple[int, int]:
    """How many different values there are, and how often the most frequent one occurs."""
    if not len(hashes):
        return 0, 0
    ordered = np.sort(hashes)
    ends = np.concatenate(([-1], np.flatnonzero(ordered[1:] != ordered[:-1]), [len(ordered) - 1]))
    return len(ends) - 1, int((ends[1:] - ends[:-1]).max())


def structure(text: str, raw: np.ndarray, n_words: int, hashes: np.ndarray) -> list[float]:
    """The values of ``STRUCTURE``. Lengths are the only metadata; they come from the text.

    ``raw`` are the bytes of the text, ``hashes`` those of its ``n_words`` words.
    """
    # Sums of byte counts up to each value, so that a range of bytes is one difference.
    upto = [0, *np.cumsum(np.bincount(raw, minlength=256)).tolist()]
    n, n_bytes = max(n_words, 1), max(len(raw), 1)
    capitals = upto[91] - upto[65]
    letters = max(capitals + upto[123] - upto[97], 1)
    kinds, top = _kinds(hashes)
    pairs = _kinds(hashes[1:] * np.uint64(31) + hashes[:-1])[0] if len(hashes) > 1 else kinds
    lines = Counter(line for line in text.split("\n") if line.strip())
    n_lines = lines.total()
    # A word ends where white space or nothing follows.
    is_end = _END_SIGN[raw]
    ends = int(np.count_nonzero(is_end[:-1] & _WHITE[raw[1:]])) + int(is_end[-1:].sum())
    return [np.log1p(len(text)), np.log1p(n_words), n_bytes / n, capitals / letters,
            (upto[58] - upto[48]) / n_bytes, (upto[48] - upto[33] + upto[65] - upto[58]) / n_bytes,
            sum(upto[s + 1] - upto[s] for s in _SIGNS) / n_bytes, (upto[34] - upto[33]) / n_bytes,
            (upto[33] - upto[32] + upto[14] - upto[9]) / n_bytes,
            np.log1p(n_lines), (upto[256] - upto[128]) / n_bytes, kinds / n,
            top / n, max(len(lines), 1) / max(n_lines, 1),
            max(lines.values(), default=1) / max(n_lines, 1), ends / n, pairs / n]


def inputs(texts: list[str]) -> Iterator[tuple[list[float], np.ndarray, np.ndarray]]:
    """Per text: structure values, its word buckets, and their weights (of Euclidean length 1)."""
    encoded = [t.encode() for t in texts]
    split = [raw.lower().split() for raw in encoded]
    flat = np.array([*chain.from_iterable(split), b""], dtype=object)[:-1]
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    lengths = [len(words) for words in split]
    # The buckets of all texts are counted at once, each text in a range of its own.
    own_range = np.repeat(np.arange(len(texts), dtype=np.int64) * WORD_BUCKETS, lengths)
    ordered = np.sort(own_range + ((hashes >> np.uint64(40)) % np.uint64(WORD_BUCKETS)).astype(np.int64))
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    buckets, logs = ordered[starts], np.log1p(np.diff(starts, append=len(ordered)))
    cuts = np.searchsorted(buckets, np.arange(len(texts) + 1) * WORD_BUCKETS).tolist()
    at = 0
    for i, (text, raw) in enumerate(zip(texts, encoded, strict=True)):
        own = hashes[at:at + lengths[i]]
        at += lengths[i]
        weights = logs[cuts[i]:cuts[i + 1]]
        yield (structure(text, np.frombuffer(raw, dtype=np.uint8), lengths[i], own),
               buckets[cuts[i]:cuts[i + 1]] - i * WORD_BUCKETS,
               weights / max(np.linalg.norm(weights), 1e-12))


def _scaled(values: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return np.clip((values - mean) / deviation, -CLIP, CLIP) / CLIP


def machine_score(machine: Machine, values: list[float], buckets: np.ndarray,
                  weights: np.ndarray) -> float:
    """Probability of label 1, in time linear in the inputs."""
    x = np.concatenate([_scaled(np.array(values), machine.mean, machine.deviation), weights])
    index = np.concatenate([np.arange(len(STRUCTURE)), len(STRUCTURE) + buckets])
    vx = machine.factors[index] * x[:, None]
    pairs = 0.5 * (vx.sum(axis=0) ** 2 - (vx ** 2).sum(axis=0)).sum()
    margin = machine.intercept + machine.linear[index] @ x + pairs
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit_machine(sample: DataFrame) -> Machine:
    """Fit on a bounded sample with columns text and label, by gradients summed over its tasks."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at:at + TEXTS_AT_ONCE]
                found = list(inputs(part["text"].fillna("").tolist()))
                yield pd.DataFrame({"label": part["label"].to_numpy(),
                                    "structure": [x[0] for x in found],
                                    "buckets": [x[1] for x in found],
                                    "weights": [x[2] for x in found]})

    rows = stage_via_parquet(sample.select("text", "label").mapInPandas(
        measure, "label double, structure array<double>, buckets array<long>, weights array<double>"))
    n = len(STRUCTURE)
    moments = rows.agg(*[F.avg(F.col("structure")[i]) for i in range(n)],
                       *[F.stddev_pop(F.col("structure")[i]) for i in range(n)]).first()
    mean, deviation = np.array(moments[:n]), np.maximum(np.array(moments[n:]), 1e-9)
    size = n + WORD_BUCKETS

    @F.udf(VectorUDT())
    def vector(values, buckets, weights):
        x = _scaled(np.array(values), mean, deviation)
        # The fit takes each stored place as an input of its own: zeros must not be stored.
        stored = np.flatnonzero(x)
        return Vectors.sparse(size, [*stored.tolist(), *(n + b for b in buckets)],
                              [*x[stored].tolist(), *weights])

    vectors = stage_via_parquet(rows.select("label", vector("structure", "buckets", "weights")
                                            .alias("features")))
    model = FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=PENALTY,
                         initStd=0.05, seed=11).fit(vectors)
    return Machine(mean, deviation, float(model.intercept), model.linear.toArray(),
                   model.factors.toArray())


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (columns doc_id and text).

    Fitted on at most ``bound`` labelled documents (labels: doc_id, quality) outside the held-out
    fold. Without examples of both labels among them every score is the share of label 1 there,
    0 without any. Null text counts as empty; repeated rows are scored each; a null doc_id is in
    the fold of the empty text.
    """
    picked = labelled_sample(labels, "quality", FOLDS, HELD_OUT, bound)
    # The bound on its rows makes the labelled side fit for a broadcast.
    sample = stage_via_parquet(docs.select("doc_id", "text").where("text is not null")
                               .join(F.broadcast(picked), "doc_id"))
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held_out = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    if not (seen.get(0.0) and seen.get(1.0)):
        share = seen.get(1.0, 0) / sum(seen.values()) if seen else 0.0
        return _answer(docs.select("doc_id", held_out, F.lit(float(share)).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(fit_machine(sample))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at:at + TEXTS_AT_ONCE]
                yield part[["doc_id"]].assign(score=[
                    machine_score(shared.value, *x) for x in inputs(part["text"].fillna("").tolist())])

    # Ids cross as text, so that a null among them doesn't turn the others into floats.
    scored = (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
              .mapInPandas(score, "doc_id string, score double")
              .withColumn("doc_id", F.col("doc_id").cast("long")))
    return _answer(scored.select("doc_id", held_out, "score"))


def _answer(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
