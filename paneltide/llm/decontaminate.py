"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only.

Texts are hashed in k-grams of ``GRAM`` words. In every run of ``WINDOW - GRAM + 1`` consecutive
k-grams the least hash is kept as a fingerprint, in items and in documents alike. Two equal spans
of ``WINDOW`` words have equal k-grams and so keep the same fingerprint: joining the fingerprints
finds every shared span of at least that length. A joined fingerprint is extended to the words
around it, which decides whether the whole window is there.

Documents first drop the k-grams whose hash is in no item, by a bit table of fixed size; it may
let strangers pass, never the reverse, and those fail in the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.tables import lower_ascii, text_key
from paneltide.sources.io import stage_via_parquet

GRAM = 5
WINDOW = 10
GRAMS_IN_WINDOW = WINDOW - GRAM + 1
#: Bits of the table that prefilters k-grams (128 KB, whatever the size of the benchmark).
FILTER_BITS = 20
#: Benchmark windows are broadcast up to this many rows (some 20 MB), else joined by a shuffle.
BROADCAST_WINDOWS = 100_000
SALTS = 16

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words; null gives none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _later(array: str, by: int) -> Column:
    return F.slice(F.col(array), by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def with_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``h1``, ``h2``, ... : hashes of all runs of so many words, for each of ``sizes``.

    ``words`` must be a column. A run's hash comes from those of its two parts, so each array is
    one pass over two others; places too near the end have no run and are cut off.
    """
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    made = {1}

    def make(rows: DataFrame, n: int) -> DataFrame:
        if n in made:
            return rows
        left = 1 << ((n - 1).bit_length() - 1)      # the largest power of two below n
        rows = make(make(rows, left), n - left)
        made.add(n)
        pairs = F.zip_with(f"h{left}", _later(f"h{n - left}", left), lambda x, y: F.xxhash64(x, y))
        return rows.withColumn(f"h{n}", F.slice(
            pairs, 1, F.greatest(F.size("words") - (n - 1), F.lit(0))))

    for n in sizes:
        rows = make(rows, n)
    return rows


def _item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, n, offset, fingerprint): the windows of all items.

    ``offset`` is the place of the fingerprint's k-gram in the window. An item of fewer words
    than a window is one window of n words, whose fingerprint is the hash of all of them.
    """
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    long = with_grams(rows, [GRAM]).where(F.size("words") >= WINDOW)
    at = long.select("item_id", "words", f"h{GRAM}", F.explode(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).alias("at"))
    grams = F.slice(f"h{GRAM}", F.col("at"), GRAMS_IN_WINDOW)
    whole = at.select("item_id", F.array_join(F.slice("words", F.col("at"), WINDOW), " ")
                      .alias("window"), F.lit(WINDOW).alias("n"), grams.alias("grams"))
    whole = whole.select("item_id", "window", "n", (F.array_position(
        "grams", F.array_min("grams")) - 1).cast("int").alias("offset"),
        F.array_min("grams").alias("fingerprint"))
    short = rows.where(F.size("words") < WINDOW)
    for n in range(1, WINDOW):
        one = with_grams(short.where(F.size("words") == n), [n])
        whole = whole.unionByName(one.select(
            "item_id", F.array_join("words", " ").alias("window"), F.lit(n).alias("n"),
            F.lit(0).alias("offset"), F.element_at(f"h{n}", 1).alias("fingerprint")))
    return whole


def _filter_table(fingerprints: DataFrame) -> Column:
    """The bit table of all fingerprints as a constant array of longs.

    ``2**FILTER_BITS`` bits in all, so what passes the driver doesn't grow with the benchmark.
    """
    slot = F.col("fingerprint").bitwiseAND((1 << FILTER_BITS) - 1)
    words = (fingerprints.groupBy(F.shiftright(slot, 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(fingerprint & 63 as int))")).alias("bits")))
    found = {r["word"]: r["bits"] for r in words.collect()}
    text = ",".join(str(found.get(i, 0)) for i in range(1 << (FILTER_BITS - 6)))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def _passes(h: Column, table: Column) -> Column:
    word = F.element_at(table, (F.shiftright(h.bitwiseAND((1 << FILTER_BITS) - 1), 6) + 1)
                        .cast("int"))
    return F.call_function("shiftrightunsigned", word,
                           h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _candidates(docs: DataFrame, table: Column, short: list[int]) -> DataFrame:
    """Staged (row, doc_id, text_key, n_words, first, n, fingerprint, at, around): candidates.

    Every document has at least one row (``first`` is true on one of them); documents without
    candidates have null in the other columns. ``at`` is the k-gram's place from 0 and
    ``around`` the words from ``reach`` before it to where its last window ends.
    """
    reach = GRAMS_IN_WINDOW - 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(),
                       words_of(F.col("text")).alias("words"))
    rows = with_grams(rows, [GRAM, *short])

    def kept(n: int, size: int) -> Column:
        hits = F.transform(f"h{size}", lambda h, i: F.when(_passes(h, table), i))
        return F.transform(F.array_compact(hits), lambda i: F.struct(
            F.lit(n).alias("n"), F.lit(size).alias("size"), i.alias("at")))

    found = F.concat(kept(WINDOW, GRAM), *[kept(n, n) for n in short])
    rows = rows.select("*", F.posexplode_outer(found).alias("nth", "hit"))
    at = F.col("hit.at")
    hashes = reduce(lambda rest, n: F.when(F.col("hit.n") == n, F.get(f"h{n}", at)).otherwise(rest),
                    short, F.get(f"h{GRAM}", at))
    begin = F.greatest(at - reach, F.lit(0))
    # Winnowed: the k-gram is the least of some full window of k-grams that it is in.
    last = F.least(at, F.size(f"h{GRAM}") - GRAMS_IN_WINDOW)
    kept_here = F.exists(F.sequence(begin, F.greatest(last, begin)), lambda i: F.array_min(
        F.slice(f"h{GRAM}", i + 1, GRAMS_IN_WINDOW)) >= F.get(f"h{GRAM}", at))
    winnowed = (F.col("hit.n") < WINDOW) | ((last >= begin) & kept_here)
    out = rows.select("row", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
                      (F.coalesce("nth", F.lit(0)) == 0).alias("first"),
                      F.when(winnowed, F.col("hit.n")).alias("n"), hashes.alias("fingerprint"),
                      at.alias("at"), begin.alias("begin"),
                      F.slice("words", begin + 1, F.lit(WINDOW + reach)).alias("around"))
    return stage_via_parquet(out.where("first or n is not null"))


def _join_windows(left: DataFrame, right: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Inner join; a small right side is broadcast, a larger one salted against hot keys."""
    if few:
        return left.join(F.broadcast(right), keys)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hits of the benchmark windows in every document.

    ``docs`` has doc_id and text, ``items`` item_id and text. Per row of ``docs``: doc_id,
    n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated. Null
    and empty texts have no words; an empty benchmark hits nothing; items without words and
    null item_ids count for nothing; repeated rows get one answer each.
    """
    return contamination(docs, items).drop("text_key")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As ``decontaminate``, with text_key, which tells rows apart that share a doc_id."""
    windows = stage_via_parquet(_item_windows(items.where("item_id is not null")).distinct())
    few = windows.count() <= BROADCAST_WINDOWS
    short = sorted(r["n"] for r in windows.where(F.col("n") < WINDOW).select("n").distinct()
                   .collect())
    table = _filter_table(windows)
    found = _candidates(docs, table, short)
    texts = windows.select("fingerprint", "n", "window", "offset").distinct()
    start = F.col("at") - F.col("offset")
    seen = F.array_join(F.slice("around", F.greatest(start - F.col("begin"), F.lit(0)) + 1,
                                F.col("n")), " ")
    hits = (_join_windows(found.where("n is not null"), texts, ["fingerprint", "n"], few)
            .where((start >= 0) & (seen == F.col("window")))
            .select("row", "window", "n", start.alias("start")).distinct())
    hits = stage_via_parquet(hits)
    # Words covered: runs are sorted by start, each adds what lies beyond the furthest end so far.
    runs = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = hits.groupBy("row").agg(F.aggregate(
        runs, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["total"] + F.greatest(F.lit(0), r["end"] - F.greatest(
            s["end"], r["start"]))).cast("long").alias("total"),
            F.greatest(s["end"], r["end"]).alias("end")))["total"].alias("n_hit"))
    owners = windows.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    items_hit = (_join_windows(hits.select("row", "window").distinct(), owners, ["window"], few)
                 .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    answer = covered.join(items_hit, "row")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return (found.where("first").select("row", "doc_id", "n_words", "text_key").join(answer, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(listed, 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated"), "text_key"))
