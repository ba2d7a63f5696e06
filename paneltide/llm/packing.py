"""Best-fit packing of tokenised documents into sequences of fixed length.

Texts become token ids once; what goes on are narrow rows, one per piece of a document. Pieces
are dealt by hash over streams of bounded length, and each stream is packed online: a fixed
number of sequences is open, each new piece goes into the one it leaves least space in, and when
another one has to be opened the fullest closes. Open sequences are found in a bitset in which
bit f is set while one with f free places is open.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.sources.io import stage_via_parquet

LENGTH = 2048
END_ID = 0
OPEN_SEQUENCES = 512
LONG_RUN = 20_000
#: Tokens of a stream: it bounds what one task packs, and costs at most the sequences left open.
STREAM_TOKENS = 16_000_000
#: And its rows, where pieces are short.
STREAM_ROWS = 1_000_000

_PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def _cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens; the first one takes the odd rest."""
    first = n % length or length
    ends = range(first, n + 1, length)
    return [(max(0, end - length) if end > first else 0, end) for end in ends]


class Vocabulary(NamedTuple):
    """A byte-level vocabulary: its tokenizer file, and the same ids as ranks.

    The ranks are merged several times as fast. Their pattern, which cuts a text into what is
    merged on its own, fails on runs of white space of hundreds of thousands of characters, so
    texts with runs of ``LONG_RUN`` go through the tokenizer file.
    """

    tokenizer: str
    ranks: str
    pattern: str


@cache
def _whole(vocabulary: Vocabulary) -> object:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.tokenizer)


@cache
def encoder(vocabulary: Vocabulary) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizer file gives them without special tokens added; names of its
    special tokens in the text get their own ids. Built once per worker process."""
    import tiktoken

    with open(vocabulary.ranks, "rb") as file:
        ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, file)}
    with open(vocabulary.tokenizer, encoding="utf-8") as file:
        named = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks,
                             special_tokens=named)
    long_run = re.compile(r"\s{%d}" % LONG_RUN)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and long_run.search(text):
            return _whole(vocabulary).encode(text, add_special_tokens=False).ids
        if any(name in text for name in named):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


def tokenize_pieces(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH,
                    end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"].fillna(""), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                for i, (a, b) in enumerate(_cut(len(ids), length)):
                    rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # Ids cross as text, so that a null among them doesn't turn the others into floats.
    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
            .mapInPandas(pieces, _PIECES).withColumn("doc_id", F.col("doc_id").cast("long")))


def best_fit(lengths: list[int], length: int = LENGTH,
             n_open: int = OPEN_SEQUENCES) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece, in the order given."""
    bits, by_free, count, opened = 0, [[] for _ in range(length + 1)], 0, 0
    where, offsets = [], []
    for n in lengths:
        fitting = bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            sequence = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if count == n_open:                       # the fullest closes
                least = (bits & -bits).bit_length() - 1
                by_free[least].pop()
                if not by_free[least]:
                    bits ^= 1 << least
                count -= 1
            sequence, free = opened, length
            opened += 1
            count += 1
        where.append(sequence)
        offsets.append(length - free)
        left = free - n
        if left:
            if not by_free[left]:
                bits |= 1 << left
            by_free[left].append(sequence)
        else:
            count -= 1
    return where, offsets


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with doc_id, piece, start, length, ids_crc32."""
    tokens, rows = pieces.agg(F.sum("length"), F.count("*")).first()
    n_streams = max(1, -(-(tokens or 0) // STREAM_TOKENS), -(-rows // STREAM_ROWS))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.select("*", order.alias("_order"),
                          F.pmod(F.hash("doc_id", "piece", "ids_crc32"), F.lit(n_streams))
                          .alias("_stream"))

    def place(stream: pd.DataFrame) -> pd.DataFrame:
        stream = stream.sort_values(["_order", "doc_id", "piece"], kind="stable")
        where, offsets = best_fit(stream["length"].tolist(), length)
        base = int(stream["_stream"].iloc[0]) << 32
        return stream.drop(columns=["_order", "_stream"]).assign(
            sequence_id=np.array(where, dtype=np.int64) + base, offset=offsets)

    text_id = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    return (text_id.groupBy("_stream").applyInPandas(place, f"{_PIECES}, sequence_id long, offset long")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH) -> DataFrame:
    """Pack every document (columns doc_id and text) into sequences of ``length`` tokens.

    Null text counts as empty: a document of its end id alone. Repeated rows are packed each.
    An empty table gives no rows.
    """
    return pack(stage_via_parquet(tokenize_pieces(docs, vocabulary, length)), length)
