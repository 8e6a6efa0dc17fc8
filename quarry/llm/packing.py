"""Packing: concatenate all documents and cut fixed windows.

First pass: every partition tokenises its documents, notes each one's offset within the partition,
and writes ids and offsets to the shared folder. The partition totals (one number per task) are
summed up to give each partition's place in the one stream of all tokens. Second pass: with its
base every partition cuts its own part of the stream at the multiples of the window, alone. A window
that reaches over the end of a partition is made of pieces of both sides, which carry the same
sequence_id; these are marked as boundary pieces. One sequence of the whole corpus is not full.

Scale: no shuffle and no group; text is tokenised once; the driver holds one number per task.

Defined results: null text is empty and gives the end id alone; ids of documents may be null or
repeat, each row is a document; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_of

#: White space that the pattern of byte_bpe may not be able to go back over (it can over 400,000 code points).
_LONG_WHITE = re.compile(r"(?<!\s)\s{100000}")
_TOKENS = "part int, doc_id long, at long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """An encoder with the ids of the byte-level BPE in a tokenizers file, special strings included.

    Merges of such a file are in the order of their ids, which are then ranks. The pattern's backtracking is bounded, so
    texts with a very long run of white space go to the tokenizers library, which gives the same ids in more time.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in visible}
    chars |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in chars)}
    back = {c: b for b, c in chars.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # Characters first, then merges in their order: the rank of a merge is its place.
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    whole = []

    def encode(text: str) -> np.ndarray:
        if _LONG_WHITE.search(text) is None:
            return encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        if not whole:
            whole.append(Tokenizer.from_file(path))
            whole[0].no_truncation()
            whole[0].no_padding()
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _tokenised(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = byte_bpe(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0)[low : low + 512], batch.column(1)[low : low + 512]
                docs = [np.concatenate([encode(t), end]).astype("<u4") for t in texts.to_pylist()]
                n = np.array([len(d) for d in docs], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                # Two bytes hold an id if all are small; readers go by the length.
                packed = [d.astype("<u2").tobytes() if d.max() < 65536 else d.tobytes() for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), ids, pa.array(starts), pa.array(n), pa.array(packed, pa.binary())],
                    names=["part", "doc_id", "at", "n", "ids"],
                )

    return run


def _cut(bases: dict[int, tuple[int, int]], window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """bases: for each partition, where it begins and ends in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part, doc, at, n, ids = (c[low : low + 512].to_pylist() for c in batch.columns)
                rows: list[tuple] = []
                for p, d, a, m, packed in zip(part, doc, at, n, ids, strict=True):
                    base, end = bases[p]
                    tokens = np.frombuffer(packed, "<u2" if len(packed) == 2 * m else "<u4").astype("<u4")
                    first = base + a
                    cuts = [0, *range(window - first % window, m, window), m]
                    for s, e in zip(cuts, cuts[1:], strict=False):
                        q, offset = divmod(first + s, window)
                        over = q * window < base or (q + 1) * window > end
                        rows.append((d, s, e - s, m, q, offset, over, tokens[s:e].tobytes()))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids"],
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, boundary, and the
    piece's ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    tokens = materialize(rows.mapInArrow(_tokenised(tokenizer_path, end_id), _TOKENS), "tokens")
    bases, base = {}, 0
    for part, total in sorted(tokens.groupBy("part").agg(F.sum("n")).collect()):
        bases[part] = (base, base + total)
        base += total
    return tokens.mapInArrow(_cut(bases, window), _PIECES)
