"""Encoding texts with a public byte-level BPE vocabulary through tiktoken and a local rank file.

Defined results: null and empty texts give an empty list; texts of any length are encoded whole; special-token
strings inside a text are ordinary text; extra columns are never read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: Unicode White_Space, what \s means in the pattern above.
SPACE = "\t-\r \x85\xa0" + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

CHUNK = 1 << 16
LONG_RUN = 1 << 10
_SAFE = re.compile(f"[^{SPACE}](?=[{SPACE}])")
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str = RANK_FILE):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(rank_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a long text where the pattern must cut as well: before white space that follows something else."""
    start = 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:] if start else text


def encode(text: str | None, rank_file: str = RANK_FILE) -> list[int]:
    """Ids of one text, equal to encoding it in one piece.

    A run of white space is one piece of the pattern save its last character before a word, so very long runs,
    which overflow the pattern's stack, are taken out and merged directly.
    """
    if not text:
        return []
    enc = encoding(rank_file)
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        for part in chunks(text[start : m.start()]):
            ids += enc.encode_ordinary(part)
        ids += enc._core_bpe.encode_single_piece(text[m.start() : end].encode())
        start = end
    for part in chunks(text[start:] if start else text):
        ids += enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], rank_file: str = RANK_FILE) -> str:
    """The exact text of ``ids``: the raw bytes are joined before they are read as UTF-8."""
    return b"".join(encoding(rank_file).decode_tokens_bytes(ids)).decode("utf-8")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """One row (``id_col``, ``ids array<int>``) for each row; a narrow pass over two columns, without a shuffle."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [np.asarray(encode(t, rank_file), dtype=np.int32) for t in texts]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """The columns ``keep`` and ``n_tokens bigint``: the number of ids of each text (0 for null and empty texts)."""

    def run(batches):
        for b in batches:
            n = [len(encode(t, rank_file)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{schema}, n_tokens bigint")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", rank_file: str = RANK_FILE) -> DataFrame:
    """The inverse of :func:`encode_documents`: (``id_col``, ``text``)."""

    def run(batches):
        for b in batches:
            texts = [decode(x or [], rank_file) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
