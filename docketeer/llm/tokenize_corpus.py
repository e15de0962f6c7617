"""Problem 8: token ids of every text by a public byte-level BPE vocabulary.

``encode`` streams Arrow batches through the tiktoken library, one encoder per Python worker.
Long texts are cut at places where the pre-splitting pattern can't have a piece that spans the cut,
so the ids are those of the uncut text while each call stays short.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import map_arrow

#: Fixed value: the pre-splitting pattern that belongs to the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_RANKS = os.environ.get("DOCKETEER_RANK_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Texts longer than this many characters are encoded in parts of about this length.
PART_CHARS = 100_000
#: Every piece of PATTERN that holds white space has it in front, so none spans a non-blank followed by a blank.
_SAFE = re.compile(r"(?<=\S)(?=\s)")
#: Without white space, no piece spans a change between letters and ASCII digits.
_SAFE_DRY = re.compile(r"(?<=[^\W\d_])(?=[0-9])|(?<=[0-9])(?=[^\W\d_])")


@lru_cache(maxsize=4)
def encoder(rank_file: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("docketeer", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """Cut a text into parts whose encodings, put together, are the encoding of the text."""
    parts, at = [], 0
    while len(text) - at > part_chars:
        cut = _SAFE.search(text, at + part_chars)
        dry = _SAFE_DRY.search(text, at + part_chars, cut.start() if cut else len(text)) if not cut or cut.start() - at > 2 * part_chars else None
        found = dry or cut
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


def encode_text(text: str | None, rank_file: str = DEFAULT_RANKS, part_chars: int = PART_CHARS) -> list[int]:
    """Ids without special tokens; their strings within a text are ordinary text. [] for null and empty."""
    if not text:
        return []
    enc = encoder(rank_file)
    if len(text) <= part_chars:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, part_chars) for i in enc.encode_ordinary(part)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids array<int>), one row for each row of ``df``.

    A map over partitions: no shuffle, and only the two columns are read. Null and empty texts give an
    empty list, blanks are encoded as they stand, repeated rows stay, an empty table gives no rows, other
    columns are ignored whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                if text:
                    if len(text) <= PART_CHARS:
                        flat += enc.encode_ordinary(text)
                    else:
                        flat += encode_text(text, rank_file)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id_", "ids"])

    return map_arrow(rows, run, f"id_ {kind.simpleString()}, ids array<int>").withColumnRenamed("id_", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str = DEFAULT_RANKS) -> DataFrame:
    """(id, text): the ids' raw bytes put together, then read as UTF-8; the exact inverse of ``encode`` (null comes back as '').

    Bytes are joined before decoding as single tokens may hold parts of a character.
    """
    rows = df.select(F.col(id_col).alias("id_"), F.col(ids_col).alias("ids_"))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            texts = [enc.decode_bytes(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id_", "text"])

    return map_arrow(rows, run, f"id_ {kind.simpleString()}, text string").withColumnRenamed("id_", id_col)
