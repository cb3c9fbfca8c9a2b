"""Operator 1. Packing by power-of-two decomposition.

A document's ids are cut in pieces of 2048 and then, by the binary digits of what is left, in pieces of falling powers of two. Every piece is
a sequence of its own, so no sequence crosses documents and none has padding; pieces of one length share a bucket, from which batches of
equal shape are drawn.

Ids are those of the `tokenizers` library for the vocabulary file. They are made here by its rank form through `tiktoken`, which gives the
same ids in a quarter of the time; texts with very long runs of white space go to `tokenizers` itself.

Defined cases: a null or empty text has the end id alone, one piece of length 1; a null doc_id or repeated rows give pieces like any other;
a text of any length is one document; further columns are left out; an empty table gives no row. sequence_id is unique in a result.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import arrow_map, column

LENGTH = 2048
END_ID = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The rank library's pattern matcher can't go through longer runs.
LONG_SPACE = re.compile(r"\s{2000}")

_LOADED: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str):
    """Text to ids, for a vocabulary file with its rank file beside it, or for one without by the library alone."""
    if vocabulary not in _LOADED:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        slow = Tokenizer.from_file(vocabulary)
        plain = lambda text: slow.encode(text, add_special_tokens=False).ids
        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

            def ids(text: str) -> list[int]:
                if SPECIAL in text or LONG_SPACE.search(text):
                    return plain(text)
                return fast.encode_ordinary(text)
        else:
            ids = plain
        _LOADED[vocabulary] = ids
    return _LOADED[vocabulary]


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """n as full sequences and then falling powers of two."""
    rest = n % length
    return [length] * (n // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length) and, if asked, the ids."""
    if length & (length - 1):
        raise ValueError("length is a power of two")
    vocabulary = vocabulary or default_vocabulary()

    def f(part: pa.RecordBatch) -> dict:
        encode = encoder(vocabulary)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids")}
        for doc_id, text in zip(column(part, "doc_id"), column(part, "text"), strict=True):
            tokens = np.array([*encode(text or ""), end_id], dtype="<u4")
            at = 0
            for n in piece_lengths(len(tokens), length):
                piece = tokens[at : at + n]
                for k, v in (("doc_id", doc_id), ("start", at), ("length", n), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(tokens)), ("bucket", n.bit_length() - 1)):
                    out[k].append(v)
                if ids:
                    out["ids"].append(piece)
                at += n
        if not ids:
            del out["ids"]
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * ids
    pieces = arrow_map(docs.select("doc_id", "text"), f, schema, [])
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def packed_documents(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return pack(docs, ids=False).select(*names)
