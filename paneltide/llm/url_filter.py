"""Urls judged by host and path rules, and beyond those by a ratio of character models.

Two variable-order Markov models, one of accepted and one of rejected urls, give each character
a probability that falls back from long contexts to short ones. The mean log ratio per character
is turned into a probability of acceptance by a logistic fit on labelled urls kept out of the
models.

The counts are kept in tables of fixed size, addressed by hashes of context and character, so
the model that tasks receive has a proven bound (``2 * 2 * ORDERS * 2**CELL_BITS`` counts) while
every labelled url is counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.tables import lower_ascii

ORDERS = 6            # contexts of 0 to 5 characters
CELL_BITS = 16        # cells per order and kind of count
SMOOTHING = 4.0       # weight of the shorter context
CALIBRATION_FOLDS = 5
BINS = 400
BIN_LIMIT = 8.0
_CELLS = 1 << CELL_BITS
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class UrlModel:
    """Log probability tables and the logistic that calibrates their ratio."""

    counts: np.ndarray      # (class, kind, order, cell); kinds: context with character, context
    slope: float
    offset: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the text after the first ``://``; both empty for null or without it."""
    text = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (lower_ascii(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2))


def matching_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of ``rules`` (host followed by a path) that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = (((host == rule_host) | host.endswith("." + rule_host))
                & path.startswith(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _positions(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters (as bytes) of all urls behind zero padding, and the url of each byte."""
    coded = [u.encode() for u in urls]
    lengths = np.fromiter((len(c) for c in coded), dtype=np.int64, count=len(coded))
    pad = b"\0" * (ORDERS - 1)
    data = np.frombuffer(b"".join(pad + c for c in coded), dtype=np.uint8)
    owner = np.repeat(np.arange(len(coded)), lengths)
    # After url j there are (j + 1) paddings before its first byte.
    place = np.arange(lengths.sum()) + (owner + 1) * (ORDERS - 1)
    return data, np.stack([owner, place])


def _cells(data: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order, the cells of (context, character) and of the context for each position."""
    shift = np.uint64(64 - CELL_BITS)
    here = data[place].astype(np.uint64) + np.uint64(1)
    context = np.zeros(len(place), dtype=np.uint64)
    for order in range(ORDERS):
        if order:
            context = (context + data[place - order].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        mixed = context ^ (context >> np.uint64(29))
        yield (((mixed + here * np.uint64(0xBF58476D1CE4E5B9)) * _MULTIPLIER >> shift).astype(np.int64),
               ((mixed + np.uint64(order)) * _MULTIPLIER >> shift).astype(np.int64))


def count_cells(urls: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """Counts (cell, n) over all urls. Tasks add up in a table of fixed size before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2, ORDERS, _CELLS), dtype=np.int64)
        for batch in batches:
            for label, part in batch.groupby(accepted):
                data, (_, place) = _positions(part[url].tolist())
                for order, cells in enumerate(_cells(data, place)):
                    for kind, cell in enumerate(cells):
                        total[int(label), kind, order] += np.bincount(cell, minlength=_CELLS)
        flat = total.ravel()
        cell = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": cell, "n": flat[cell]})

    return (urls.select(url, F.col(accepted).cast("int").alias(accepted))
            .mapInPandas(count, "cell long, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")))


def log_ratio(urls: Sequence[str], counts: np.ndarray) -> np.ndarray:
    """Mean over the characters of log P(accepted) - log P(rejected); 0 for an empty url."""
    data, (owner, place) = _positions(urls)
    p = np.full((2, len(place)), 1.0 / 256)
    for order, (pair, context) in enumerate(_cells(data, place)):
        for label in (0, 1):
            seen, total = counts[label, 0, order][pair], counts[label, 1, order][context]
            # Cells are shared, so a pair may seem more frequent than its context.
            p[label] = (np.minimum(seen, total) + SMOOTHING * p[label]) / (total + SMOOTHING)
    gain = np.log(p[1]) - np.log(p[0])
    n = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, weights=gain, minlength=len(urls)) / np.maximum(n, 1)


def _fit_logistic(x: np.ndarray, rejected: np.ndarray, accepted: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(accepted | x) by Newton steps on binned counts, lightly penalised."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    n = rejected + accepted
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (accepted - n * p) - 1e-2 * (theta - [1.0, 0.0])
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (max(float(theta[0]), 1e-3), float(theta[1]))


def fit_url_model(urls: DataFrame, url: str = "url", accepted: str = "accepted") -> UrlModel:
    """Fit on all rows whose ``accepted`` is 0 or 1 and whose url isn't null.

    A fifth of them, by checksum, calibrates instead of training. Where either class is empty
    in that fifth, the ratio is used as it is; without any labelled url every ratio is 0.
    """
    known = urls.where(F.col(url).isNotNull() & F.col(accepted).isNotNull())
    fold = F.crc32(F.col(url)) % CALIBRATION_FOLDS == 0
    counts = np.zeros((2, 2, ORDERS, _CELLS), dtype=np.float32)
    found = count_cells(known.where(~fold), url, accepted).toPandas()
    counts.reshape(-1)[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    binned = (score_urls(known.where(fold), UrlModel(counts, 1.0, 0.0), url)
              .withColumn("bin", F.round((F.col("log_ratio") + BIN_LIMIT) * (BINS / (2 * BIN_LIMIT))))
              .withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS), F.col("bin"))))
              .groupBy("bin").agg(F.sum(1 - F.col(accepted)).alias("no"), F.sum(accepted).alias("yes"))
              .toPandas())
    no, yes = binned["no"].to_numpy(float), binned["yes"].to_numpy(float)
    slope, offset = 1.0, 0.0
    if no.sum() and yes.sum():
        x = binned["bin"].to_numpy(float) * (2 * BIN_LIMIT / BINS) - BIN_LIMIT
        slope, offset = _fit_logistic(x, no, yes)
    return UrlModel(counts, slope, offset)


def score_urls(rows: DataFrame, model: UrlModel, url: str = "url") -> DataFrame:
    """Add ``log_ratio`` and ``p_accept``. A null or empty url has ratio 0."""
    shared = rows.sparkSession.sparkContext.broadcast(model.counts)
    slope, offset = model.slope, model.offset

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[url].fillna("").tolist()
            ratio = log_ratio(texts, shared.value) if texts else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(slope * ratio + offset, -30, 30)))
            yield batch.assign(log_ratio=ratio, p_accept=p)

    schema = rows.schema.simpleString()[len("struct<"):-1]
    return rows.mapInPandas(score, f"{schema},log_ratio:double,p_accept:double")


def judge_urls(rows: DataFrame, block: Sequence[str], allow: Sequence[str],
               threshold: float = 0.5) -> DataFrame:
    """Host, path, rule and verdict of every row (columns page_id and url).

    Rows that a rule decides are the labelled urls of the two models; the others follow the
    models: allowed where the probability of acceptance reaches ``threshold``. A url without
    characters is allowed, and so is every url while one of the classes has no example.
    """
    host, path = host_and_path(F.col("url"))
    # Ids cross as text, so that a null among them doesn't turn the others into floats.
    known = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    known = known.withColumn("rule", matching_rule(F.col("host"), F.col("path"),
                                                   [*block, *allow]))
    by_rule = F.when(F.col("rule").isin(list(allow)), 1).when(F.col("rule").isNotNull(), 0)
    known = known.withColumn("accepted", by_rule)
    model = fit_url_model(known)
    both = model.counts[:, 1, 0].sum(axis=1).all()
    allowed = (F.col("p_accept") >= threshold) | (F.coalesce(F.col("url"), F.lit("")) == "")
    if not both:
        allowed = F.lit(True)
    decided = F.when(F.col("accepted") == 1, "allow").when(F.col("accepted") == 0, "block")
    return (score_urls(known, model)
            .withColumn("verdict", F.coalesce(decided, F.when(allowed, "allow").otherwise("block")))
            .select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule",
                    "verdict", "log_ratio", "p_accept"))
