"""Byte-level BPE with the tiktoken library: encoding of whole texts and raw-byte decoding."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from bidlens.llm.common import add_columns, table

# Longest stretch of a text, in characters, given to the library at once.
CHUNK = 100_000
# No match of the pattern runs from a visible character into white space, so a text may be cut there.
SAFE = re.compile(r"\S(?=[ \t\n])")
_ENCODERS: dict = {}


def encoder(rank_lines: bytes, pattern: str) -> tiktoken.Encoding:
    """One encoder per Python worker and vocabulary."""
    key = (hash(rank_lines), len(rank_lines), pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x)}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, chunk: int = CHUNK):
    """Stretches of a text cut only at safe boundaries; one without a boundary stays whole."""
    start = 0
    while len(text) - start > chunk:
        cut = SAFE.search(text, start + chunk - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None, chunk: int = CHUNK) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    if len(text) <= chunk:
        return np.array(enc.encode_ordinary(text), dtype="<u4").tobytes()
    return b"".join(np.array(enc.encode_ordinary(p), dtype="<u4").tobytes() for p in pieces(text, chunk))


def _shared_lines(spark: SparkSession, rank_file: str):
    """The rank file's bytes for all workers: its size is that of the vocabulary, whatever the input."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``token_ids``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    A null or empty text gives no ids; special tokens are ordinary text. Rows, repeated ones too, stay as
    they are; an existing column ``token_ids`` is replaced, other columns pass through.
    """
    lines = _shared_lines(docs.sparkSession, rank_file)

    def make(texts):
        enc = encoder(lines.value, pattern)
        return [pa.array([encode_text(enc, t.as_py(), chunk) for t in texts], pa.binary())]

    return add_columns(docs, [text], [StructField("token_ids", BinaryType())], make)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded``: the raw bytes of the ids, valid UTF-8 or not. Null ids give no bytes."""
    lines = _shared_lines(tokens.sparkSession, rank_file)

    def make(packed):
        enc = encoder(lines.value, pattern)
        found = [enc.decode_bytes(np.frombuffer(p.as_py() or b"", "<u4").tolist()) for p in packed]
        return [pa.array(found, pa.binary())]

    return add_columns(tokens, [ids], [StructField("decoded", BinaryType())], make)


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, *vocabulary()).drop("text"), *vocabulary())
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
