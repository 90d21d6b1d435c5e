"""Token counts of whole texts without their ids.

Byte-level merges never leave a pre-token, so a text has as many tokens as its pre-tokens have. Each distinct pre-token
of the corpus is encoded once, by the vocabulary's own library; documents hold how often each of their pre-tokens
occurs and sum what comes back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import postings
from .common import table
from .vocabularies import PIECES, BytePairs, Pool, Sentences, loaded, public_path


def vocabulary(path: str) -> BytePairs | Sentences:
    return loaded(Sentences if path.endswith(".model") else BytePairs, path)


def piece_counts(path: str) -> Callable[[], Callable[[list[bytes]], np.ndarray]]:
    """Numbers of tokens of pieces, by the vocabulary of each task."""

    def begin() -> Callable[[list[bytes]], np.ndarray]:
        known = vocabulary(path)

        def counts(pieces: list[bytes]) -> np.ndarray:
            texts = [p.decode() for p in pieces]
            return np.concatenate([known.lengths(texts[at : at + PIECES]) for at in range(0, len(texts), PIECES)])

        return counts

    return begin


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 block_characters: int = postings.CHARACTERS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, by the vocabulary at `path` (default: the public byte_bpe_50k.json), as
    its library gives them without added special tokens: strings of special tokens inside a text are one token.

    Null and empty texts have none; repeated rows are counted each; a null id stays null; an empty table gives an empty
    result; other columns are ignored. Texts of any length are cut window by window, and one that is longer than a block
    is a block of its own."""
    path = path or public_path("byte_bpe_50k.json")
    spaced = path.endswith(".model")  # the model puts a space before a text

    def gather():
        pool = Pool(vocabulary(path))

        def block(texts: list[str | None]):
            pool.clear()
            codes = [pool.codes(" " + t if spaced else t) if t else np.zeros(0, dtype=np.int64) for t in texts]
            rows = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
            flat = np.concatenate(codes)
            names = [p.encode() for p in pool.code]
            order = postings.name_order(names)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            held = postings.Postings()
            held.add(*postings.merged(place[flat], rows, np.ones(len(flat), dtype=np.int64), len(texts)))
            return held, {"n_bytes": [len((t or "").encode()) for t in texts]}, [names[i] for i in order.tolist()]

        return block

    made = postings.blocks(docs, id_col, text_col, {"n_bytes": T.LongType()}, gather, block_characters)
    back = postings.by_name(made, piece_counts(path))
    return postings.sums(made, back, postings.runs_of, ["n_bytes"], {"n_tokens": lambda value, times: value["n"] * times})


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts have no tokens."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)
