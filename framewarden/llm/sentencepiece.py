"""SentencePiece encoding and decoding of documents by a weighted transducer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .piece_transducer import PieceModel, Transducer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Ids in one batch from a Python worker.
BATCH_IDS = 2_000_000


def share_model(spark: SparkSession, path: str) -> Broadcast:
    """The model file's bytes, at most 64 MB, in a dictionary where a worker keeps its compiled machines."""
    with open(path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("a model file of more than 64 MB is not sent to every executor")
    PieceModel.parse(data)
    return spark.sparkContext.broadcast({"data": data})


def compiled(shared: Broadcast, most_cached: int) -> Transducer:
    own = shared.value
    if "machine" not in own:
        own["machine"] = Transducer(PieceModel.parse(own["data"]), most_cached)
    return own["machine"]


def encode(docs: DataFrame, model_path: str = MODEL, most_cached: int = 1_000_000) -> DataFrame:
    """One row per input row: ``doc_id, n_pieces, ids, round_trip``.

    ``round_trip`` says whether decoding the ids gives the text again, which
    fails where a text holds the mark U+2581 itself.  A null or empty text has
    no ids; repeated rows are encoded each; an empty table gives an empty one.
    A worker keeps the paths of at most ``most_cached`` stretches.
    """
    shared = share_model(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared, most_cached)

        def batch_of(doc_ids: list, ids: list[bytes], same: list[bool]) -> pa.RecordBatch:
            counts = np.array([len(i) // 4 for i in ids], dtype=np.int64)
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum(counts, out=ends[1:])
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            columns = [pa.array(doc_ids, pa.int64()), pa.array(counts), lists, pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids", "round_trip"])

        for batch in batches:
            doc_ids, ids, same, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                code = machine.encode(text)
                doc_ids.append(doc_id)
                ids.append(code)
                same.append(machine.decode(np.frombuffer(code, dtype=np.int32).tolist()) == text)
                size += len(code) // 4
                if size >= BATCH_IDS:
                    yield batch_of(doc_ids, ids, same)
                    doc_ids, ids, same, size = [], [], [], 0
            if doc_ids:
                yield batch_of(doc_ids, ids, same)

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``; null ids give an empty text."""
    shared = share_model(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared, 0)
        for batch in batches:
            texts = [machine.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded["doc_id"].cast("bigint").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id bigint, text string")
