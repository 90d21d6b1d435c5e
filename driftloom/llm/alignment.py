"""Which tokens of one vocabulary stand for the same bytes as which of another one, over a whole corpus.

Both tokenisations of a text are laid on its bytes; where tokens of both end, a group ends, and tokens of one group are
linked. Cuts come from the spans that the libraries give (characters for `tokenizers`, the pieces of the proto for
sentencepiece); tokens that are less than a character are cut by the bytes that they stand for. How many documents hold
a pair of ids linked is counted over the corpus and comes back to each document by blocks (see `postings`), so neither
texts nor links are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import postings
from .common import table
from .vocabularies import BytePairs, Pool, Sentences, loaded, public_path

#: A pair of ids as one number: a * SHIFT + b.
SHIFT = 1 << 20
#: A block's characters: both tokenisations of all its texts are laid out at once.
CHARACTERS = 1 << 21
#: Links that are laid out at a time, but all of one id at once.
LINKS = 1 << 19
#: Distinct pieces whose tokens a task keeps from block to block; beyond that the first fifth stays.
KEPT = 200_000

COLUMNS = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}


def tokens(pool: Pool, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, number of pieces of each text, whether the text's tokens stand for just its bytes)."""
    codes = [pool.codes(t) for t in texts]
    pool.learn()
    return np.concatenate([np.zeros(0, dtype=np.int64), *codes]), np.array([len(c) for c in codes], dtype=np.int64), np.array([bool(pool.whole[c].all()) for c in codes], dtype=bool)


def laid_out(pool: Pool, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, byte offsets at which they end) over all texts in a row."""
    size = pool.sizes[codes]
    return pool.tokens(codes, np.cumsum(size) - size)


def side(group: np.ndarray, ids: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of distinct ids of groups, and how many each group has."""
    both, times = np.unique(group * SHIFT + ids, return_counts=True)
    return both // SHIFT, both % SHIFT, times, np.bincount(both // SHIFT, minlength=n_groups)


def link(a_group: np.ndarray, a_ids: np.ndarray, b_group: np.ndarray, b_ids: np.ndarray, row_of_group: np.ndarray, n_rows: int, most: int = LINKS) -> tuple[postings.Postings, np.ndarray]:
    """Pairs of ids that share groups with the rows that hold them, and the links of each row. Every pair of distinct ids
    of a group is laid out once, with its occurrences as a number, for some ids of a at a time."""
    held, n_links = postings.Postings(), np.zeros(n_rows, dtype=np.int64)
    n = len(row_of_group)
    group, a, times, _ = side(a_group, a_ids, n)
    _, b, b_times, per_group = side(b_group, b_ids, n)
    first = np.cumsum(per_group) - per_group
    order = np.argsort(a, kind="stable")
    group, a, times = group[order], a[order], times[order]
    upto = np.cumsum(per_group[group])
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    at = 0
    while at < len(a):
        full = np.searchsorted(upto, (upto[at - 1] if at else 0) + most)
        to = starts[np.searchsorted(starts, full, "right") - 1] if full < len(a) else len(a)
        if to <= at:  # one id has more: all of it
            later = starts[starts > at]
            to = later[0] if len(later) else len(a)
        g, x, t = group[at:to], a[at:to], times[at:to]
        many = per_group[g]
        b_at = np.repeat(first[g] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rows, both = np.repeat(row_of_group[g], many), np.repeat(t, many) * b_times[b_at]
        np.add.at(n_links, rows, both)
        held.add(*postings.merged(np.repeat(x, many) * SHIFT + b[b_at], rows, both, n_rows))
        at = to
    return held, n_links


def group_texts(a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids in the order `a1,a2|b1;a3|b2`, kind of what follows each: 0 comma, 1 bar, 2 semicolon)."""
    n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a = np.arange(len(a_ids)) + before_b[a_group]
    at_b = np.arange(len(b_ids)) + (before_a + n_a)[b_group]
    ids, after = np.empty(len(a_ids) + len(b_ids), dtype=np.int64), np.zeros(len(a_ids) + len(b_ids), dtype=np.int64)
    ids[at_a], ids[at_b] = a_ids, b_ids
    ends = np.cumsum(n_a + n_b)
    after[ends - 1] = 2
    after[ends - n_b - 1] = 1
    return ids, after


class Aligner:
    """A task's pools of both vocabularies."""

    def __init__(self, a_path: str, b_path: str, links: int = LINKS) -> None:
        self.links = links
        self.a, self.b = Pool(loaded(BytePairs, a_path, True)), Pool(loaded(Sentences, b_path))
        most = max(len(p.vocabulary.table) for p in (self.a, self.b))
        self.texts = [f"{i}{mark}" for mark in ",|;" for i in range(most)]
        self.most = most

    def block(self, texts: list[str | None]):
        """(postings, columns, no names) of a block of texts."""
        for pool in (self.a, self.b):
            if len(pool.code) > KEPT:
                pool.trim(KEPT // 5)
        given = [" " + t if t else "" for t in texts]  # a null or empty text has no tokens
        (a_codes, a_pieces, a_whole), (b_codes, b_pieces, b_whole) = tokens(self.a, given), tokens(self.b, given)
        whole = a_whole & b_whole
        a_ids, a_ends = laid_out(self.a, a_codes[np.repeat(whole, a_pieces)])
        b_ids, b_ends = laid_out(self.b, b_codes[np.repeat(whole, b_pieces)])
        rows, n = np.flatnonzero(whole), len(texts)
        text_ends = np.cumsum([len(given[i].encode()) for i in rows], dtype=np.int64)
        # Every text ends with tokens of both, so groups stay within texts.
        place = np.searchsorted(b_ends, a_ends)
        cut = b_ends[np.minimum(place, len(b_ends) - 1)] == a_ends if len(b_ends) else np.zeros(0, dtype=bool)
        cuts = a_ends[cut]
        a_group, b_group = np.cumsum(cut) - cut, np.searchsorted(cuts, b_ends)
        row = lambda ends: rows[np.searchsorted(text_ends, ends)] if len(rows) else np.zeros(0, dtype=np.int64)
        row_of_group = row(cuts)
        held, n_links = link(a_group, a_ids, b_group, b_ids, row_of_group, n, self.links)
        counts = {"n_a": np.bincount(row(a_ends), minlength=n), "n_b": np.bincount(row(b_ends), minlength=n), "n_groups": np.bincount(row_of_group, minlength=n)}
        ids, after = group_texts(a_ids, a_group, b_ids, b_group, len(cuts))
        codes, at, digests = ids + after * self.most, 0, []
        for n_tokens in (counts["n_a"] + counts["n_b"]).tolist():
            text = "".join(map(self.texts.__getitem__, codes[at : at + n_tokens].tolist()))
            digests.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n_tokens else "")
            at += n_tokens
        return held, {**{c: v.tolist() for c, v in counts.items()}, "n_links": n_links.tolist(), "groups_sha256": digests}, None


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          block_characters: int = CHARACTERS, links: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row;
    pairs: a, b and count, the number of rows that hold the two ids linked, and best, whether no id of b has a higher
    count with a.

    a is a byte-level JSON of `tokenizers` (default byte_bpe_50k) over a space and the text, b a sentencepiece model
    (default piece_bpe_32k), which puts the space itself; strings of special tokens are plain text. Null and empty texts
    and those that either vocabulary does not give back byte by byte (as with U+2581) have no tokens. Repeated rows count
    each; a null id stays null; empty tables give empty results; other columns are ignored. A long text is a block of its
    own; groups of any size are laid out by distinct ids."""
    a_path, b_path = a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model")
    made = postings.blocks(docs, id_col, text_col, COLUMNS, lambda: Aligner(a_path, b_path, links).block, block_characters)
    pairs = made.filter("slot is not null").groupBy("key").agg(F.sum("in_rows").alias("count"))
    # An id of a has at most as many partners as b has ids.
    a = F.expr(f"key div {SHIFT}")
    pairs = pairs.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy(a))).cast("long"))
    outs = {"n_best": lambda value, times: value["best"] * times, "count_sum": lambda value, times: value["count"] * times}
    documents = postings.sums(made, postings.by_key(made, pairs), postings.slots_of, list(COLUMNS), outs)
    return documents, pairs.select(a.alias("a"), F.expr(f"key % {SHIFT}").alias("b"), "count", F.col("best").cast("boolean").alias("best"))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts have zeros and an empty digest."""
    return align(table(spark, sf_dir, "documents"))[0]
