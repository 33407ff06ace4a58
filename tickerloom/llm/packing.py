"""Packing by power-of-two decomposition.

A document of n tokens (END_ID included) is cut into n // 1024 pieces of 1024 tokens and, for the rest, one piece per
set bit of n % 1024, largest first. Every piece is a sequence of its own, its length a power of two, so sequences
never cross documents and need no padding; sequences of one length form a bucket, and a bucket's batches are dense.

Token ids are those of the tokenizers library and the public byte-level BPE file, its added tokens included: their
strings in a text become their ids. They are computed in Arrow batches by the ranks of the same vocabulary, a fifth of
the library's time: texts are cut at the added tokens that the file lists, and inside white-space runs instead of the
word pattern's look-ahead, which gives the same pieces of text without back-tracking. Tests hold the ids against the
library's. Memory is bounded by a batch of texts and FLUSH_IDS ids.

sequence_id numbers the rows of a partition and its task, so it needs no exchange: reruns over the same files with the
same partitioning give the same numbers, other partitionings other ones.

Null text is empty text: one piece, END_ID alone. Repeated rows are packed once each. An empty table gives an empty
result. Other columns are not read, so clashing names do no harm. A null doc_id stays null.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 1024
END_ID = 0
FLUSH_IDS = 1 << 20

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"

# Unicode's White_Space characters, as the vocabulary's word pattern takes them.
_BLANK = "\t-\r \x85\xa0  -     　"
#: Inside a run of white space before a word: all but its last character belong to what stands before.
_CUT = re.compile(f"(?<=[{_BLANK}])(?=[{_BLANK}][^{_BLANK}])")
#: The word pattern without its look-ahead.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


Vocabulary = tuple[str, str]


def default_vocabulary() -> Vocabulary:
    """Paths of the tokenizer's file and of its vocabulary as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The strings that a tokenizer's file turns into ids of their own before anything else."""
    with open(tokenizer, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids; one encoder per worker process."""
    import tiktoken

    tokenizer, words = vocabulary
    with open(words, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding("byte_bpe", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = added_tokens(tokenizer)
    at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(text: str) -> list[int]:
        parts = _CUT.split(text)
        return encode(text) if len(parts) == 1 else [i for part in parts for i in encode(part)]

    def ids(text: str) -> np.ndarray:
        if at_added is None or not any(token in text for token in added):
            return np.array(plain(text), dtype="<u4")
        out: list[int] = []
        for k, part in enumerate(at_added.split(text)):
            out.extend([added[part]] if k % 2 else plain(part))
        return np.array(out, dtype="<u4")

    return ids


def piece_lengths(tokens: int, most: int = MAX_LENGTH) -> list[int]:
    """Powers of two, largest first, that sum to tokens; most is a power of two."""
    full, rest = divmod(tokens, most)
    return [most] * full + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, vocabulary: Vocabulary | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset."""
    vocabulary = vocabulary or default_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]
        types = [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                start, key = 0, doc_id.as_py()
                for n in piece_lengths(len(ids), max_length):
                    for column, value in zip(rows, (key, start, n, len(ids), ids[start : start + n].tobytes()), strict=True):
                        column.append(value)
                    start += n
                held += len(ids)
                if held >= FLUSH_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                    rows, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    pieces = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pack, SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def buckets(pieces: DataFrame) -> DataFrame:
    """length, sequences and documents_ended (whose last piece it is) of every bucket: what a batch sampler draws from."""
    return pieces.groupBy("length").agg(F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("start") + F.col("length") == F.col("doc_tokens")).alias("documents_ended"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length, for batches of equal lengths."""
    pieces.write.partitionBy("length").parquet(path)
