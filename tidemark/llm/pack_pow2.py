"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n
(after as many full-length pieces as fit), longest first.  Every piece is a sequence of
its own: lengths are powers of two, so nothing is padded and no sequence crosses a
document.  Equal lengths form a bucket; a sequence's id starts with its bucket, so sorting
by it lists the buckets one after another, ready for batches of one length each.

Ids are numbered inside a partition, without a shuffle or a count over the corpus:
bucket * 2**58 + partition * 2**34 + number in the partition's bucket.

Null text is empty (only the end token); null doc ids and repeated rows are packed like any
others; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_rows, pick
from .token_cache import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Bytes of a worker's word tables a generation; a caller whose workers have held other things before may give less.
TABLE_BYTES = 256 << 20


def binary_lengths(n: int, most: int) -> list[int]:
    """Power-of-two lengths, longest first, that add up to n, none above ``most``."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, seq_len: int = 4096, end_id: int = 2,
                      id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per piece: its document, place and ids (little-endian unsigned 32 bit), and
    its sequence.  ``seq_len`` must be a power of two."""
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    end = end_id.to_bytes(4, "little")

    def make():
        enc = encoder(tokenizer_path, table_bytes)
        part = TaskContext.get().partitionId()
        seen = [0] * seq_len.bit_length()

        def run(cols):
            for doc, text in zip(*cols):
                ids = enc.encode(text) + end
                n, start = len(ids) // 4, 0
                for size in binary_lengths(n, seq_len):
                    k = size.bit_length() - 1
                    seq = (k << 58) + (part << 34) + seen[k]
                    seen[k] += 1
                    yield doc, start, size, ids[4 * start:4 * (start + size)], n, seq, 0
                    start += size
        return run

    rows = pick(docs, id_column, text_column).selectExpr(f"cast({id_column} as long) {id_column}", text_column)
    return map_rows(rows, make, _ARROW, SCHEMA, weigh=lambda r: 64 + len(r[3]), keeps=True)
