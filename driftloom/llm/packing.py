"""Cost-balanced sequence packing.

Documents are tokenised inside the scan's own tasks. Every full run of `capacity` tokens is a sequence of its
own; the tails are packed in groups of bounded size, again inside the task, so packing moves no row over the
network and holds one group in memory. In a group the cost of a piece of n tokens is linear * n + quadratic * n**2
(attention stays inside documents); pieces go in descending order to the cheapest sequence that has room for
them. When no sequence has room for a whole piece it is cut at the room of the cheapest one. The last tokens
of a group fill sequences whose lengths are powers of two, so nothing is padded.

Token ids come from tiktoken over the ranks and special tokens of byte_bpe_50k.json; the tests hold them against
`tokenizers`, which takes three to four times as long.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

#: A document ends with this id.
SEPARATOR = 0
_ENCODERS: dict = {}


def encoder(ranks_path: str | None = None):
    """Encoder of the vocabulary at ranks_path (default: the public byte_bpe_50k), one per process, with
    the added tokens of the JSON of the same name, if there is one, as its special tokens."""
    import public_tokenizers as public
    import tiktoken

    path = ranks_path or public.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added, whole = {}, os.path.splitext(path)[0] + ".json"
        if os.path.exists(whole):
            with open(whole, encoding="utf-8") as lines:
                added = {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) of a packing that fills every sequence."""
    total = sum(lengths)
    room = np.array([capacity] * (total // capacity) + powers_of_two(total % capacity), dtype=np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            to = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            n = min(left, int(room[to]))
            out.append((item, start, n, to, int(used[to])))
            room[to] -= n
            used[to] += n
            cost[to] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, capacity: int = 1024, group: int = 2048, linear: float = 1.0, quadratic: float = 1 / 1024,
         ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bit).

    Null text is empty: its document is the separator alone. Repeated rows are packed as documents of their
    own; an empty table gives an empty result; a null id stays null. `group` bounds the tails that are packed
    together, not how many are packed.
    """
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([(id_col, id_type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows, tails = encoder(ranks_path), [], []
        next_id = TaskContext.get().partitionId() << 40

        def flush() -> None:
            nonlocal next_id
            packed = balance([len(t[3]) for t in tails], capacity, linear, quadratic)
            for item, start, n, to, offset in packed:
                doc_id, first, doc_tokens, ids = tails[item]
                rows.append((doc_id, first + start, n, doc_tokens, next_id + to, offset, ids[start : start + n].tobytes()))
            next_id += 1 + max((p[3] for p in packed), default=-1)
            tails.clear()

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in schema]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
            rows.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), SEPARATOR).astype("<u4")
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, len(ids), next_id, 0, ids[start : start + capacity].tobytes()))
                    next_id += 1
                if whole < len(ids):
                    tails.append((doc_id, whole, len(ids), ids[whole:]))
                if len(tails) >= group:
                    flush()
                if len(rows) >= 2000:
                    yield batch()
        flush()
        yield batch()

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        tasks, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return out


def op3_cost_packing(spark, sf_dir: str) -> DataFrame:
    """All documents; a null text is its separator alone, pieces of equal length stand in the order in which they are read."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
