"""Personal data: fixed patterns, and contexts learned from what they find.

Seeds are the spans of the fixed patterns. The two words before a seed are a lexical pattern;
everything shaped like an identifier that follows the same two words is an instance of it.
Patterns are scored by the instances they extract and instances by the patterns that extract
them, in rounds over the whole corpus. Patterns of high confidence then name identifiers that no
fixed pattern knows. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.tables import BROADCAST_KEYS
from paneltide.sources.io import stage_via_parquet

# The kinds in the order they are listed in, and their patterns. Repetitions are
# possessive where giving back characters can't help, so long runs cost no stack and no retries.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match of the kind passes.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

#: Something shaped like an identifier: no white space, four digits or more after its first sign.
CANDIDATE = r"(?<![A-Za-z0-9_.:/#-])[A-Za-z0-9](?:[A-Za-z_.:/#-]*+[0-9]){4}[A-Za-z0-9_.:/#-]*+"
#: A context is made of whole words within so many characters before an identifier: longer words
#: are no context.
CONTEXT_CHARS = 80
#: Matches of a text whose lengths are added up at once.
CHUNK = 64
ROUNDS = 3
MIN_SEEDS = 3             # different seeds that a pattern must have before it counts
MIN_CONFIDENCE = 0.6
PRIOR = 1.0               # unknown instances added to those of each pattern



def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _running_sums(numbers: Column) -> Column:
    """The sums of all beginnings of an array of ints, from the sums of chunks of ``CHUNK``."""
    def within(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / CHUNK).cast("int") - 1, F.lit(0)))
        totals = F.transform(chunks, lambda c: _sum(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK))))
        before = _let(totals, lambda ts: F.transform(ts, lambda _, c: _sum(F.slice(ts, F.lit(1), c))))
        chunk = lambda i: F.floor(i / CHUNK).cast("int")
        return _let(before, lambda bs: F.transform(xs, lambda _, i: F.get(bs, chunk(i)) + _sum(
            F.slice(xs, chunk(i) * CHUNK + 1, i % CHUNK + 1))))

    return _let(numbers, within)


def spans_of(text: Column, pattern: str, hint: str,
             valid: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost, non-overlapping matches that are ``valid``: start and end in code points, match."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(
        (F.length(p) + F.length(m)).alias("length"), m.alias("match")))

    def placed(ps: Column) -> Column:
        ends = _running_sums(F.transform(ps, lambda p: p["length"]))
        spans = F.zip_with(ps, ends, lambda p, end: F.struct(
            (end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("value")))
        return spans if valid is None else F.filter(spans, lambda s: valid(s["value"]))

    return F.when(text.rlike(hint), _let(pairs, placed)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the checksum of a card number of at most 19 digits holds."""
    digits = F.reverse(_digits(value))
    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(
        digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(parts, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255,
                                                                    F.lit(False)))
    length = F.length(_digits(value))
    if kind == "phone":
        return length.between(8, 15)
    if kind == "card":
        return F.when(length.between(16, 19), _luhn(value)).otherwise(F.lit(False))
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add one column of spans per kind; ``text`` must not be null."""
    for kind in KINDS:
        docs = docs.withColumn(kind, spans_of(F.col("text"), PATTERNS[kind], HINTS[kind],
                                              partial(_valid, kind)))
    return docs


def listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans, comma-joined, in the order of the kinds."""
    def texts(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[texts(k, spans) for k, spans in kinds.items()]), ",")


def _context(text: Column, start: Column) -> Column:
    """The last two words before ``start``, lower-cased, digits as 0; null where there are none."""
    begin = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    before = F.substring(text, begin + 1, start - begin)
    words = F.regexp_extract(before, r"(\S+\s+\S+)\s*[\"'(\[]*$", 1)
    plain = F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"\s+", " ")
    return F.when(plain != "", plain)


def _instances(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, context) of seeds and, with kind null, of candidates."""
    def of_kind(kind: str | None, spans: str) -> Column:
        return F.transform(spans, lambda s: F.struct(
            F.lit(kind).cast("string").alias("kind"),
            *[s[c].alias(c) for c in ("start", "end", "value")]))

    spans = F.concat(*[of_kind(k, k) for k in KINDS], of_kind(None, "candidates"))
    rows = found.select("row", "text", F.explode(spans).alias("s"))
    return rows.select("row", "s.*", _context(F.col("text"), F.col("s.start")).alias("context"))


def learn_patterns(instances: DataFrame) -> DataFrame:
    """(context, kind, confidence) of the patterns kept, scored over the whole corpus.

    An instance's score is 1 if it is a seed, else the chance that one of its patterns is right.
    A pattern's confidence is the mean score of its different instances, with ``PRIOR`` unknown
    ones added. Occurrences are counted before anything is joined, so a common context is one
    row per instance, not one per occurrence.
    """
    graph = stage_via_parquet(
        instances.where("context is not null").groupBy("context", "value")
        .agg(F.max("kind").alias("kind")))
    seeds = (graph.where("kind is not null").groupBy("context", "kind")
             .agg(F.count("*").alias("n")).groupBy("context")
             .agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("seeds"))
             .where(F.col("seeds") >= MIN_SEEDS))
    edges = stage_via_parquet(graph.withColumn("seed", F.col("kind").isNotNull()).drop("kind")
                              .join(seeds, "context"))
    scores = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(ROUNDS):
        patterns = stage_via_parquet(
            edges.join(scores, "value").groupBy("context", "kind")
            .agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence")))
        miss = F.log(1 - F.least(F.col("confidence"), F.lit(1 - 1e-9)))
        scores = stage_via_parquet(
            edges.join(patterns.select("context", "confidence"), "context").groupBy("value")
            .agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(miss))).alias("score")))
    return patterns.where(F.col("confidence") >= MIN_CONFIDENCE)


def _find(rows: DataFrame) -> DataFrame:
    """Base spans per kind and ``more``, the spans of learned patterns, for every row.

    ``rows`` has row, text (not null) and any columns to carry along; text is kept where there
    are spans, else null.
    """
    found = base_spans(rows).withColumn(
        "candidates", spans_of(F.col("text"), CANDIDATE, "[0-9]"))
    base = F.concat(*[F.col(k) for k in KINDS])
    free = _let(base, lambda own: F.filter("candidates", lambda c: ~F.exists(
        own, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    found = found.withColumn("candidates", free)
    any_span = F.size(F.concat(base, F.col("candidates"))) > 0
    # Texts are needed for contexts only, so they go along only where there are spans.
    found = stage_via_parquet(found.withColumn("text", F.when(any_span, F.col("text"))))
    instances = stage_via_parquet(_instances(found.where("text is not null")))
    patterns = learn_patterns(instances)
    more = stage_via_parquet(
        instances.where("kind is null and context is not null").drop("kind")
        .join(patterns, "context").groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("more")))
    few = more.count() <= BROADCAST_KEYS
    return (found.drop("candidates").join(F.broadcast(more) if few else more, "row", "left")
            .withColumn("more", F.coalesce("more", F.array().cast(
                "array<struct<start:int,end:int,kind:string>>"))))


def _places(kind: str) -> Column:
    """Start and end of all spans of a kind, in order."""
    learned = F.filter("more", lambda s: s["kind"] == kind)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    return F.array_sort(F.concat(F.transform(kind, place), F.transform(learned, place)))


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every row (columns doc_id and text; null text counts as empty).

    doc_id, the number of base spans per kind, base_sha256 and spans. The base spans are those
    of the fixed patterns; ``spans`` also holds what the learned patterns found, under the kind
    of the pattern's seeds and never overlapping a base span. Repeated rows get one answer each.
    Texts without any digit and ``@`` have no spans and take part in nothing.
    """
    found = _find(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                              F.coalesce("text", F.lit("")).alias("text")))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed({k: F.col(k) for k in KINDS}), 256).alias("base_sha256"),
        listed({k: _places(k) for k in KINDS}).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with every span of ``text`` replaced by its kind.

    ``n_chars``, where there is one, follows the text. Spans that overlap are replaced once,
    under the kind of the first. Null texts stay null.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = _find(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc"),
                              F.coalesce("text", F.lit("")).alias("text")))

    def marked(kind: str) -> Column:
        return F.transform(_places(kind), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.array_sort(F.concat(*[marked(k) for k in KINDS]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]),
                         F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= state["at"], F.struct(
            s["end"].alias("at"), F.concat(state["parts"], F.array(piece)).alias("parts"))).otherwise(
            F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts")))

    joined = F.aggregate(spans, begin, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    new = F.when(F.size(spans) > 0, joined).otherwise(F.col("doc.text"))
    found = found.withColumn("new", new)
    replaced = {"text": F.col("new"), "n_chars": F.when(
        F.size(spans) > 0, F.length("new").cast("long")).otherwise(F.col("doc.n_chars"))
        if "n_chars" in docs.columns else None}
    return found.select(*[(replaced[c] if c in replaced else F.col(f"doc.`{c}`")).alias(c)
                          for c in docs.columns])
