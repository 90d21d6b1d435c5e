"""Tokenizers of the public vocabularies by pieces: texts are cut where no merge can cross, and each distinct piece is
encoded once by its own library, with the places in the piece where its tokens end."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import count, islice
from typing import NamedTuple

import numpy as np

#: Characters of a text that are cut into pieces at a time.
WINDOW = 1 << 20
#: Pieces that are encoded at a time.
PIECES = 5000


class BytePairs:
    """A byte-level BPE in a JSON of `tokenizers`. Pieces are the library's pre-tokens; strings of added tokens in a
    text are pieces of their own, or plain text with `plain`."""

    def __init__(self, path: str, plain: bool = False) -> None:
        import json

        import public_tokenizers as public
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as lines:
            found = json.load(lines)
        before = found["pre_tokenizer"] or {}
        odd = [t["content"] for t in found["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or found["normalizer"] or found["post_processor"] or odd:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self._find, self._unsure = regex.compile(public.PATTERN).findall, _unassigned()
        names = sorted((re.escape(t["content"]) for t in found["added_tokens"]), key=len, reverse=True)
        self._added = re.compile("(" + "|".join(names) + ")") if names and not plain else None
        code = {c: b for b, c in enumerate(_byte_letters())}
        by_id = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())
        self.table = [b""] * (by_id[-1][0] + 1)
        special = {t["content"] for t in found["added_tokens"]}
        for i, t in by_id:
            self.table[i] = t.encode() if t in special else bytes(code[c] for c in t)
        self.size = np.array([len(t) for t in self.table])

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pieces of the text in order, in lists of bounded length unless a piece itself is long."""
        parts = self._added.split(text) if self._added else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield [part]
                continue
            if not part.isascii() and self._unsure[np.frombuffer(part.encode("utf-32-le"), dtype="<u4")].any():
                yield [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                continue
            at = 0
            while len(part) - at > WINDOW:
                # A space after a character that is no white space begins a piece, whatever stands around.
                to = part.find(" ", at + WINDOW)
                while to > 0 and part[to - 1].isspace():
                    to = part.find(" ", to + 1)
                if to < 0:
                    break
                yield self._find(part[at:to])
                at = to
            yield self._find(part[at:] if at else part)

    def _encoded(self, pieces: list[str]):
        return self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)

    def encode(self, pieces: list[str]) -> Encoded:
        """The pieces' tokens. The library's character spans are the coarse cuts; where tokens share a character, they are
        cut by the bytes that they stand for."""
        made, text = self._encoded(pieces), "".join(pieces)
        ids, piece = np.array(made.ids, dtype=np.int64), np.array(made.word_ids, dtype=np.int64)
        letters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        at = np.zeros(len(letters) + 1, dtype=np.int64)
        np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000), out=at[1:])
        last = np.cumsum([len(p) for p in pieces])
        spans = np.array(made.offsets, dtype=np.int64).reshape(-1, 2) + np.append(0, last[:-1])[piece][:, None]
        alone = np.append(spans[1:, 0] >= spans[:-1, 1], np.ones(min(len(ids), 1), dtype=bool))
        return refined(self.table, self.size, pieces, at[last], ids, at[spans[:, 1]], alone, np.bincount(piece, minlength=len(pieces)))

    def lengths(self, pieces: list[str]) -> np.ndarray:
        """How many tokens each piece has."""
        return np.bincount(np.array(self._encoded(pieces).word_ids, dtype=np.int64), minlength=len(pieces))


class Sentences:
    """A sentencepiece model. Pieces are runs of spaces (or their mark) with the word that follows, for models whose entries have spaces
    in front only and which put one space before a text: no merge crosses from a word to the next one's spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as protocol

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = protocol.ModelProto()
        with open(path, "rb") as file:
            found.ParseFromString(file.read())
        how = found.normalizer_spec
        inner = [p.piece for p in found.pieces if "▁" in p.piece.lstrip("▁")]
        if how.precompiled_charsmap or not how.add_dummy_prefix or how.remove_extra_whitespaces or inner or any(p.type == p.USER_DEFINED for p in found.pieces):
            raise ValueError(f"{path} is no model whose words can be encoded apart")
        self._find = re.compile("[ ▁]+[^ ▁]*").findall
        self._space = self.model.piece_to_id("▁")
        self.table = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in found.pieces]
        self.size = np.array([len(t) for t in self.table])

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text that begins with the space that the model would put before it."""
        at = 0
        while len(text) - at > WINDOW:
            to = text.find(" ", at + WINDOW)
            while to > 0 and text[to - 1] in " ▁":
                to = text.find(" ", to + 1)
            if to < 0:
                break
            yield self._find(text[at:to])
            at = to
        yield self._find(text[at:] if at else text)

    def encode(self, pieces: list[str]) -> Encoded:
        """As BytePairs.encode. Pieces are encoded in a row, which is the same, as each begins with a space, but for those of
        spaces alone, which would run into the next one's. The model's spans are the coarse cuts; entries without a span
        (the space that the model adds, all but the last byte of a character in bytes) are cut by the bytes that they
        stand for."""
        blank = [i for i, p in enumerate(pieces) if not p.strip(" ▁")]
        rows = [pieces[a:b] for i, j in zip([-1, *blank], [*blank, len(pieces)]) for a, b in ((i, i + 1), (i + 1, j)) if 0 <= a < b]
        return Encoded(*map(np.concatenate, zip(*map(self._encode_row, rows)))) if rows else Encoded(*[np.zeros(0, dtype=np.int64)] * 4, np.zeros(0, dtype=bool))

    def _encode_row(self, pieces: list[str]) -> Encoded:
        text = "".join(pieces)
        if len(text) == 1:  # the model adds no space to an empty text
            found, stops = [self._space], [0]
        else:
            tokens = self.model.encode(text[1:], return_type="proto").pieces
            found, stops = [t.id for t in tokens], [t.end for t in tokens]  # each span begins where the last one ends
        ids, stops = np.array(found, dtype=np.int64), np.array(stops, dtype=np.int64)
        first = len(text[0].encode())  # what stands before the text that the model is given
        ends = np.cumsum([len(p.encode()) for p in pieces])
        return refined(self.table, self.size, pieces, ends, ids, stops + first, np.diff(stops, prepend=0) > 0, None)

    def lengths(self, pieces: list[str]) -> np.ndarray:
        """How many tokens each piece has."""
        return self.encode(pieces).counts


class Encoded(NamedTuple):
    """Tokens of pieces one after the other: ids, the bytes of the piece at which they end; and for each piece its number
    of tokens, its bytes and whether the tokens stand for just these."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    whole: np.ndarray


def refined(table: list[bytes], size: np.ndarray, pieces: list[str], piece_ends: np.ndarray, ids: np.ndarray, coarse: np.ndarray, alone: np.ndarray, counts: np.ndarray | None) -> Encoded:
    """Ends of tokens from coarse cuts where these hold, else counted on from the cut before by the bytes of the entries."""
    upto = np.cumsum(size[ids])
    last = np.maximum.accumulate(np.where(alone, np.arange(len(ids)), -1))
    ends = np.where(last < 0, upto, coarse[last] + upto - upto[last])
    counts = np.diff(np.searchsorted(ends, piece_ends, "right"), prepend=0) if counts is None else counts
    sizes = np.diff(piece_ends, prepend=0)
    data, given = b"".join([table[i] for i in ids.tolist()]), "".join(pieces).encode()
    whole = np.ones(len(pieces), dtype=bool)
    if data != given:
        to = np.append(0, upto)[np.cumsum(counts)].tolist()
        whole = np.array([data[a:b] == p.encode() for a, b, p in zip([0, *to], to, pieces)], dtype=bool)
    return Encoded(ids, ends - np.repeat(piece_ends - sizes, counts), counts, sizes, whole)


def _unassigned() -> np.ndarray:
    """Which characters have no category: whether they are letters is a matter of the version of Unicode, on which the
    pattern library and the tokenizer's may differ, so texts with them are cut by the tokenizer."""
    return np.fromiter((unicodedata.category(chr(code)) == "Cn" for code in range(0x110000)), dtype=bool, count=0x110000)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Numbered(dict):
    """Numbers of what it is asked for, in order of first asking."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Pool:
    """Codes of distinct pieces, and the tokens of each once it is asked for."""

    def __init__(self, vocabulary: BytePairs | Sentences) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.code = Numbered()
        self.parts = {name: [np.zeros(0, dtype=bool if name == "whole" else np.int64)] for name in Encoded._fields}

    def trim(self, n: int) -> None:
        """Keeps the n pieces that came first, among them most of the frequent ones."""
        self.code, held = Numbered(islice(self.code.items(), n)), int(self.counts[:n].sum())
        for name in Encoded._fields:
            self.parts[name] = [self.parts[name][0][: held if name in ("ids", "ends") else n].copy()]

    def codes(self, text: str) -> np.ndarray:
        out = [np.fromiter(map(self.code.__getitem__, pieces), dtype=np.int64, count=len(pieces)) for pieces in self.vocabulary.cut(text)]
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, dtype=np.int64), *out])

    def learn(self) -> None:
        """Encodes the pieces that are new, some at a time."""
        new = list(islice(self.code, len(self.counts), None))
        for at in range(0, len(new), PIECES):
            for name, more in zip(Encoded._fields, self.vocabulary.encode(new[at : at + PIECES])):
                self.parts[name].append(more)
        for name, parts in self.parts.items():
            self.parts[name] = [np.concatenate(parts)]

    ids, ends, counts, sizes, whole = (property(lambda self, name=name: self.parts[name][0]) for name in Encoded._fields)

    def tokens(self, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the tokens of pieces that start at these bytes."""
        n = self.counts[codes]
        first = (np.cumsum(self.counts) - self.counts)[codes]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[at], self.ends[at] + np.repeat(start, n)


_LOADED: dict[tuple, object] = {}


def loaded(make: Callable, *args):
    """One vocabulary of its kind per process."""
    key = (make, *args)
    if key not in _LOADED:
        _LOADED[key] = make(*args)
    return _LOADED[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
