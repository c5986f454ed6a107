"""Packing by power-of-two decomposition: documents as pieces of binary lengths, equal lengths together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from caseflow.llm.packing import word_ids
from caseflow.llm.ragged import flat_texts, row_chunks
from caseflow.llm.token_count import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 2
#: Texts are encoded together until they have this many bytes.
CHUNK_BYTES = 2 << 20

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, bucket int")


def binary_lengths(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each document, in their order: (document of each piece, its length).

    A document of n tokens is n // capacity pieces of ``capacity`` (a power of
    two) and then one piece for each bit that is set in the rest, from the
    highest down, so every length is a power of two and they sum to n.
    """
    bits = capacity >> np.arange(capacity.bit_length())
    times = np.where(bits == capacity, tokens[:, None] // capacity, (tokens[:, None] & bits) > 0)
    document = np.repeat(np.arange(len(tokens)), times.sum(1))
    return document, np.repeat(np.tile(bits, len(tokens)), times.ravel())


def decompose(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID,
              with_ids: bool = False) -> DataFrame:
    """Cut all documents into sequences whose lengths are powers of two; one row for each piece.

    Returns doc_id, ``start``, ``length``, ``ids_crc32`` (of the piece's ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``bucket`` (log2 of the length), with ``with_ids`` also ``ids``.
    A piece is a sequence of its own: none holds tokens of two documents and, its
    length being a power of two, none is padded.  A bucket holds the sequences
    of one length; a batch drawn from one bucket has no ragged rows
    (:func:`write_buckets`).  Sequence ids rise from bucket to bucket: bucket,
    task and place among the task's sequences of the bucket.

    Documents are read where they lie and nothing is shuffled, so neither a
    hot source nor copies matter, and a lost task is simply run again.  Ids
    depend on how the input is dealt over tasks; write the result if several
    readers must agree on them.

    Null text is empty: its document is the end id alone.  Rows that repeat an
    id are decomposed one by one; extra columns are ignored; an empty table
    gives an empty result.  Lengths never tie for a place: each piece has its own
    sequence.  Memory follows the longest text.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        made = np.zeros(capacity.bit_length(), np.int64)  # sequences of each bucket so far
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                ids = [i + end for i in encode.of([flat[offsets[k]:offsets[k + 1]].tobytes() for k in range(a, b)])]
                tokens = np.fromiter(map(len, ids), np.int64, b - a) // 4
                document, length = binary_lengths(tokens, capacity)
                first = np.concatenate([[0], np.cumsum(tokens)[:-1]])
                start = np.cumsum(length) - length - first[document]
                bucket = np.frexp(length)[1] - 1
                place = np.empty(len(bucket), np.int64)
                for k in range(len(made)):
                    mine = np.flatnonzero(bucket == k)
                    place[mine] = made[k] + np.arange(len(mine))
                    made[k] += len(mine)
                parts = [ids[d][4 * s:4 * (s + n)] for d, s, n in zip(document.tolist(), start.tolist(), length.tolist())]
                columns = [doc_ids.slice(a, b - a).take(pa.array(document)), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(tokens[document]),
                           pa.array(bucket.astype(np.int64) << 56 | task << 32 | place),
                           pa.array(np.zeros(len(start), np.int64)), pa.array(bucket, pa.int32())]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_ids:
                    values = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), values))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return (docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
            .mapInArrow(pieces, SCHEMA + (", ids array<int>" if with_ids else "")))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write sequences as Parquet, one folder for each length, so that a batch reads rows of one length only."""
    sequences.write.partitionBy("bucket").parquet(path)
