"""Weights by key for documents: each document holds keys a number of times, and a value of the key (its count in the
whole corpus, its number of tokens) is needed for the document's sums.

A task gathers blocks of documents of bounded size. A block is one row that holds, compressed, which of its keys each of
its documents holds how often; its distinct keys, as short rows or packed by hash, meet the values and go back to their
block, where the sums are taken. So what is shuffled grows with the distinct keys of blocks, not with the words of
documents, and a key that every document holds counts once a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut

#: A block ends at so many characters or rows.
CHARACTERS, ROWS = 8 << 20, 1 << 14


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed byte by byte of their places."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), dtype=np.uint8)
    return planes.reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def merged(keys: np.ndarray, rows: np.ndarray, times: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, times) by key and row, with equal ones summed."""
    if not len(keys):
        return keys, rows, times
    both = keys * n_rows + rows
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.diff(both, prepend=both[0] - 1))
    return both[first] // n_rows, both[first] % n_rows, np.add.reduceat(times[order], first)


class Postings:
    """Keys of a block's rows, with how often each row holds them; added in ascending order of keys, each key at once."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.holders: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, keys: np.ndarray, rows: np.ndarray, times: np.ndarray) -> None:
        """Sorted by (keys, rows), without repeats."""
        first = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, dtype=np.int64)
        holders = np.diff(np.append(first, len(keys)))
        step = np.diff(rows, prepend=0)
        step[first] = rows[first]
        self.keys.append(keys[first])
        self.holders.append(holders)
        self.rows.append(step)
        self.times.append(times)

    def columns(self) -> tuple[np.ndarray, np.ndarray, dict]:
        keys, holders, rows, times = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (self.keys, self.holders, self.rows, self.times))
        return keys, holders, {"n_keys": len(keys), "n_held": len(rows), "holders": packed(holders), "held_by": packed(rows), "times": packed(times)}


def read_postings(head: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, row, times) of each link of a block, slots counting its keys."""
    holders, steps, times = (unpacked(head[c], head[n]) for c, n in (("holders", "n_keys"), ("held_by", "n_held"), ("times", "n_held")))
    slot = np.repeat(np.arange(len(holders)), holders)
    if not len(steps):
        return slot, steps, times
    first = np.cumsum(holders) - holders
    total = np.cumsum(steps)
    return slot, total - np.repeat(total[first] - steps[first], holders), times


HEAD = [T.StructField("n_keys", T.LongType()), T.StructField("n_held", T.LongType()), T.StructField("names_size", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("holders", "held_by", "times", "names")]]


def blocks(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, T.DataType],
           gather: Callable[[], Callable[[list[str | None]], tuple[Postings, dict[str, list], list[bytes] | None]]], characters: int = CHARACTERS) -> DataFrame:
    """A table with a row per block: ids and `columns` as arrays, postings and, if they are texts, the names of its keys.
    Keys that are numbers have a row each (block, slot, key, in_rows: how many documents of the block hold it).

    gather() is called once a task and gives a function of a block's texts: (postings, values of the columns, names)."""
    fields = [T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("in_rows", T.LongType()),
              T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *[T.StructField(c, T.ArrayType(t)) for c, t in columns.items()], *HEAD]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def batch(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, block = gather(), TaskContext.get().partitionId() << 32
        for ids, texts in gathered(batches, characters):
            postings, values, names = made(texts)
            keys, holders, head = postings.columns()
            lists = {c: pa.array([v], type=arrow.field(c).type) for c, v in {"ids": ids, **values}.items()}
            if names is not None:
                head |= {"names": packed_names(names), "names_size": len(BETWEEN.join(names))}
            yield batch(1, block=pa.array([block]), **lists, **{c: pa.array([v]) for c, v in head.items()})
            for at in range(0, len(keys) if names is None else 0, 20_000):
                part = keys[at : at + 20_000]
                yield batch(len(part), block=pa.array(np.full(len(part), block)), slot=pa.array(np.arange(at, at + len(part))), key=pa.array(part), in_rows=pa.array(holders[at : at + 20_000]))
            block += 1

    return cut(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema), "blocks")


def gathered(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts in blocks of bounded size; a text that is longer is a block of its own with what came before."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i in range(b.num_rows):  # one by one: a batch may be large
            text = b.column(1)[i].as_py()
            ids.append(b.column(0)[i].as_py())
            texts.append(text)
            size += len(text or "")
            if size >= characters or len(ids) >= ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def by_key(table: DataFrame, values: DataFrame) -> DataFrame:
    """(of, slot, values): for each key row its block, place there, and what `values` (key, numbers) says of the key."""
    keys = table.filter("slot is not null").select("block", "slot", "key")
    return keys.join(values.hint("merge"), "key").select(F.col("block").alias("of"), "slot", *[c for c in values.columns if c != "key"])


def slots_of(found: pa.Table, n: int) -> dict[str, np.ndarray]:
    """The numbers of a block's key rows by slot."""
    out = {}
    for c in found.column_names:
        if c not in ("of", "slot"):
            out[c] = np.zeros(n, dtype=np.int64)
            out[c][found["slot"].to_numpy()] = found[c].to_numpy()
    return out


#: Names are joined by a byte that UTF-8 has not.
BETWEEN = b"\xff"


def name_order(names: list[bytes]) -> np.ndarray:
    """The order of names by hash."""
    return np.argsort(np.fromiter(map(zlib.crc32, names), dtype=np.uint32, count=len(names)), kind="stable")


def packed_names(names: list[bytes]) -> bytes:
    return pa.compress(BETWEEN.join(names), "zstd", asbytes=True)


def by_name(table: DataFrame, value: Callable[[], Callable[[list[bytes]], np.ndarray]], share: int = 200_000) -> DataFrame:
    """(of, first, n, numbers): for each run of a block's names, in order of hash, what value() says of them, asked once
    for each distinct name. Hashes are dealt into as many ranges as make about `share` names of all blocks each; a range
    is read as a stream that holds its distinct names, of which the blocks bring each at most once."""
    total = table.agg(F.sum("n_keys")).first()[0] or 0
    ranges = max(1, -(-total // share))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, data, size = (c[i].as_py() for c in b.columns)
                names = pa.decompress(data, size, "zstd", asbytes=True).split(BETWEEN) if size else []
                at = np.fromiter(map(zlib.crc32, names), dtype=np.uint64, count=len(names)) * np.uint64(ranges) >> np.uint64(32)
                first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1)).tolist()
                parts = [BETWEEN.join(names[x:y]) for x, y in zip(first, [*first[1:], len(names)])]
                yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int64)), pa.array([block] * len(first), pa.int64()), pa.array(first, pa.int32()), pa.array(parts, pa.binary())], names=["range", "of", "first", "names"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known, now = value(), {}, None
        for b in batches:
            n, numbers = [], []
            for at, data in zip(b.column(0).to_pylist(), b.column(3)):
                if at != now:
                    known, now = {}, at
                names = data.as_py().split(BETWEEN)
                new = [name for name in names if name not in known]
                known.update(zip(new, asked(new).tolist()) if new else ())
                n.append(len(names))
                numbers.append(packed(np.array([known[name] for name in names])))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(numbers, pa.binary())], names=["of", "first", "n", "numbers"])

    dealt = table.select("block", "names", "names_size").mapInArrow(deal, "range long, of long, first int, names binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(ask, "of long, first int, n int, numbers binary")


def runs_of(found: pa.Table, n: int) -> dict[str, np.ndarray]:
    """The numbers of a block's names by slot."""
    out = np.zeros(n, dtype=np.int64)
    for first, size, data in zip(*[found[c].to_pylist() for c in ("first", "n", "numbers")]):
        out[first : first + size] = unpacked(data, size)
    return {"n": out}


def sums(table: DataFrame, back: DataFrame, read: Callable[[pa.Table, int], dict[str, np.ndarray]], columns: list[str],
         outs: dict[str, Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]]) -> DataFrame:
    """One row per document: doc_id, the columns, and for each of outs the sum of f(values of the link's key, times)
    over the document's links. read() gives the values by slot from the rows of `back` (of, ...) for a block."""
    heads = table.filter("slot is null").select("block", "ids", *columns, *[f.name for f in HEAD if f.name not in ("names", "names_size")])
    kinds = {c: table.schema[c].dataType.elementType for c in ("ids", *columns)}
    schema = T.StructType([T.StructField("doc_id", kinds.pop("ids")), *[T.StructField(c, t) for c, t in kinds.items()], *[T.StructField(c, T.LongType()) for c in outs]])
    arrow = to_arrow_schema(schema)

    def run(head: pa.Table, found: pa.Table) -> pa.Table:
        row = head.to_pylist()[0]
        slot, doc, times = read_postings(row)
        value = {c: v[slot] for c, v in read(found, row["n_keys"]).items()}
        total = {c: np.zeros(len(row["ids"]), dtype=np.int64) for c in outs}
        for c, f in outs.items():
            np.add.at(total[c], doc, f(value, times))
        data = {"doc_id": row["ids"], **{c: row[c] for c in columns}, **total}
        return pa.table([pa.array(data[f.name], type=f.type) for f in arrow], schema=arrow)

    return heads.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, schema)
