"""Toxicity of whole texts: boosted trees over dense features, calibrated isotonically.

The features are densities of toxic words (a small fixed list, and the words that mark toxic
texts among the labelled ones), their nearness to a second person, and rates of capitals,
punctuation and disguised words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.labelled import MAX_LABELLED, fold_of, labelled_sample
from paneltide.llm.tables import text_key
from paneltide.sources.io import stage_via_parquet

FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
TREES = 20
DEPTH = 4
NEAR = 5                  # words between a toxic word and a second person
SPAN = 50                 # words of the densest span
LEARNED_WORDS = 100
LEARNED_SHARE = 0.01      # of the toxic texts that a learned word must be in
LEARNED_ODDS = 2.5        # logarithm of its odds
CALIBRATION_SHARE = 4     # one labelled text in so many calibrates
TIE_BREAK = 0.01          # weight of the raw score, which orders texts within a calibrated step

# Insults and second persons in English, French, German and Spanish.
INSULTS = frozenset("""
    idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless
    disgusting clown jerk creep freak retard imbecile dumbass bastard bitch asshole shit fuck
    fucking crap hate kill die shut vermin coward liar ugly filthy
    imbécile crétin débile connard salope merde ordure minable nul dégoûtant
    dummkopf trottel arschloch scheisse scheiße drecksack widerlich hässlich abschaum
    idiota estúpido imbécil tonto basura asqueroso mierda cabrón pendejo patético
    """.split())
SECOND_PERSON = frozenset("""
    you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein
    deine euch euer ihr usted ustedes vosotros tú ti tuyo
    """.split())
# Signs that stand for letters in disguised words.
SIGNS = str.maketrans("013457@$!|", "oieastasil")

_TOKEN = re.compile(r"[^\W_]+")
_CAPS = re.compile(r"\b[A-Z]{2,}\b")
# Starts only where a run of letters does and never gives letters back: linear in the text.
_DISGUISED = re.compile(r"(?<![A-Za-z])[A-Za-z]++[@$!|*0-9]++[A-Za-z]++[@$!|*0-9A-Za-z]*+")
_STRETCHED = re.compile(r"([a-z])\1\1")
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_SIGN_BYTES = np.frombuffer(b"#$%&*@|~^_<>=+", dtype=np.uint8)

FEATURES = ("insult_density", "insult_count", "insult_kinds", "learned_density", "learned_count",
            "learned_kinds", "densest_span", "second_person", "near_second_person", "capitals",
            "capital_words", "exclamations", "questions", "punctuation", "signs", "disguised",
            "disguised_insults", "stretched", "length")


def text_features(text: str, learned: frozenset[str]) -> list[float]:
    """The values of ``FEATURES``; all 0 for an empty text."""
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    words = _TOKEN.findall(text.lower())
    n, n_bytes = max(len(words), 1), max(int(raw.sum()), 1)
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    marked = [i for i, w in enumerate(words) if w in learned]
    person = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
    toxic = np.array(sorted({*insults, *marked}))
    densest = near = 0
    if len(toxic):
        densest = int((np.searchsorted(toxic, toxic + SPAN) - np.arange(len(toxic))).max())
        if len(person):
            near = int((np.searchsorted(person, toxic + NEAR, "right")
                        > np.searchsorted(person, toxic - NEAR)).sum())
    disguised = [w.lower() for w in _DISGUISED.findall(text)]
    letters = max(int(raw[_UPPER].sum() + raw[_LOWER].sum()), 1)
    return [len(insults) / n, np.log1p(len(insults)), float(len({words[i] for i in insults})),
            len(marked) / n, np.log1p(len(marked)), float(len({words[i] for i in marked})),
            float(densest), len(person) / n, near / n, raw[_UPPER].sum() / letters,
            len(_CAPS.findall(text)) / n, raw[33] / n_bytes, raw[63] / n_bytes,
            (raw[33:48].sum() + raw[58:65].sum()) / n_bytes, raw[_SIGN_BYTES].sum() / n_bytes,
            len(disguised) / n,
            float(sum(w.translate(SIGNS).replace("*", "") in INSULTS for w in disguised)),
            len(_STRETCHED.findall(text)) / n, np.log1p(len(words))]


def learned_words(texts: DataFrame) -> list[str]:
    """Words that mark toxic texts (columns text, label), the same for any order of rows.

    Counted once per text, over different texts; one labelled both ways counts as toxic. At most
    ``LEARNED_WORDS`` are returned.
    """
    texts = texts.groupBy("text").agg(F.max("label").alias("label"))
    rows = texts.select("label", F.explode(F.array_distinct(F.split(
        F.lower("text"), r"[^\p{L}\p{Nd}]+"))).alias("word")).where("word <> ''")
    totals = texts.agg(
        F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).first()
    yes, no = totals["yes"] or 0.0, totals["no"] or 0.0
    if not yes or not no:
        return []
    counted = rows.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (yes - F.col("a") + 0.5))
                 / ((F.col("b") + 0.5) / (no - F.col("b") + 0.5)))
    best = (counted.where(F.col("a") >= max(3.0, LEARNED_SHARE * yes)).withColumn("odds", odds)
            .where(F.col("odds") >= LEARNED_ODDS)
            .orderBy(F.desc("odds"), "word").limit(LEARNED_WORDS))
    return [r["word"] for r in best.select("word").collect()]


def with_features(docs: DataFrame, learned: list[str]) -> DataFrame:
    """(doc_id, text_key, features): one row per row of ``docs``; null text counts as empty."""
    known = frozenset(learned)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [text_features(t, known) for t in batch["text"].fillna("")]
            yield batch[["doc_id", "text_key"]].assign(features=values)

    # Ids cross as text, so that a null among them doesn't turn the others into floats.
    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", text_key())
            .mapInPandas(measure, "doc_id string, text_key long, features array<double>")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, text_key of every row (columns doc_id and text).

    Fitted on at most ``bound`` labelled documents (labels: doc_id, toxic) outside the held-out
    fold. Without examples of both labels among them every score is the share of label 1 there,
    0 without any. Repeated rows are scored each; a null doc_id is in the fold of the empty text.
    """
    picked = labelled_sample(labels, "toxic", FOLDS, HELD_OUT, bound)
    # The bound on its rows makes the labelled side fit for a broadcast.
    texts = stage_via_parquet(docs.select("doc_id", "text").where("text is not null")
                              .join(F.broadcast(picked), "doc_id"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION_SHARE)) == 0
    # Nothing is learned from the rows that calibrate, words included.
    learned = learned_words(texts.where(~calibrates))
    rows = stage_via_parquet(with_features(docs, learned))
    held_out = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    sample = stage_via_parquet(
        with_features(texts.select("doc_id", "text"), learned)
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "label", array_to_vector("features").alias("vector")))
    counts = {(r["c"], r["label"]): r["n"] for r in
              sample.groupBy(calibrates.alias("c"), "label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if any(not counts.get((False, y)) for y in (0.0, 1.0)):
        share = sum(n for (_, y), n in counts.items() if y) / total if total else 0.0
        return _answer(rows.select("doc_id", held_out, F.lit(float(share)).alias("score"), "text_key"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                          seed=7, maxMemoryInMB=64).fit(sample.where(~calibrates))
    raw = vector_to_array("probability")[1].alias("raw")
    fitted = model.transform(sample.where(calibrates)).select(raw, "label")
    scored = model.transform(rows.withColumn("vector", array_to_vector("features")))
    scored = scored.select("doc_id", held_out, raw, "text_key")
    calibrated = F.col("raw")
    if all(counts.get((True, y)) for y in (0.0, 1.0)):
        steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="iso")
        scored = steps.fit(fitted).transform(scored)
        calibrated = (1 - TIE_BREAK) * F.col("iso") + TIE_BREAK * F.col("raw")
    return _answer(scored.select("doc_id", "held_out", calibrated.alias("score"), "text_key"))


def _answer(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
