"""Token counts and alignments against the unmodified libraries, text by text."""

import hashlib
import random
import unicodedata
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import alignment, token_counts, vocabularies

from .conftest import CLASHING

JSON, MODEL = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(3)
    alphabet = "ab  \n\t'sré日本𐍈ก🏽‍ 1²#=-▁́\xa0　\x00\x1c"
    texts = [None, "", " ", "  ", "\n", "a", " a ", "it's  we'll\n\n x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<s> </s>", "a▁b", "▁", "x ▁ y",
             "=" * 5000, "ab" * 3000, " " * 2000 + "x", "日本語" * 700, "𐍈" * 300, "🏽‍" * 90, "word " * 30_000, "é" * 999 + " ", "x" * (vocabularies.WINDOW + 5), ("ab  c\n" * 300_000)[: vocabularies.WINDOW * 2 + 3]]
    texts += ["a\u0558b \U000323b0 x1\U00011de01", "\u0378\u0378a <|endoftext|>\u0558"]  # letters and numbers of later versions of Unicode
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(300)]


def table(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same text"), (3, "same text"), (3, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()]), rows


def test_classes_of_all_characters(tokenizer):
    """The pattern cuts every character as the library's own pre-tokenizer does."""
    cut = vocabularies.loaded(vocabularies.BytePairs, JSON).cut
    find = lambda text: [piece for part in cut(text) for piece in part]
    unsure = vocabularies.loaded(vocabularies.BytePairs, JSON)._unsure
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    sure = [c for c in chars if not unsure[ord(c)]]
    assert len(sure) > 280_000
    for at in range(0, len(sure), 20_000):
        text = "".join(f"a{c}1{c}!{c}" for c in sure[at : at + 20_000])
        spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert find(text) == [text[a:b] for a, b in spans]
    assert all(c.isspace() for c in chars if find(f"a{c}b") == ["a", c, "b"] and unicodedata.category(c)[0] == "Z")


def test_counts_equal_the_library(spark, tokenizer, model):
    docs, rows = table(spark, odd_texts())
    for path, count in ((JSON, lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)), (MODEL, lambda t: len(model.encode(t)))):
        found = sorted([tuple(r) for r in token_counts.count_tokens(docs, path, block_characters=50_000).collect()], key=str)
        assert found == sorted([(i, len((t or "").encode()), count(t) if t else 0) for i, t in rows], key=str)
    assert token_counts.count_tokens(docs.filter("doc_id = -5")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab  \n'slé日𐍈12!_▁<|>"), min_size=1, max_size=60))
def test_pieces_join_to_the_library_tokens(text):
    for kind, args, given_ in ((vocabularies.BytePairs, (JSON, True), text), (vocabularies.Sentences, (MODEL,), " " + text)):
        known = vocabularies.loaded(kind, *args)
        pieces = [p for part in known.cut(given_) for p in part]
        assert "".join(pieces) == given_
        made = known.encode(pieces)
        whole = known.tokenizer.encode(text, add_special_tokens=False).ids if kind is vocabularies.BytePairs else known.model.encode(text)
        assert made.ids.tolist() == whole and known.lengths(pieces).tolist() == made.counts.tolist()
        assert made.sizes.tolist() == [len(p.encode()) for p in pieces]
        at = 0
        for piece, n, right in zip(pieces, made.counts, made.whole):
            parts = [known.table[i] for i in made.ids[at : at + n]]
            assert right == (b"".join(parts) == piece.encode())
            if right:
                assert made.ends[at : at + n].tolist() == [sum(map(len, parts[: k + 1])) for k in range(n)]
            at += n


def test_a_trimmed_pool_goes_on(tokenizer):
    pool, rng = vocabularies.Pool(vocabularies.loaded(vocabularies.BytePairs, JSON, True)), random.Random(1)
    for _ in range(5):
        text = " ".join(rng.choice(["the", "é", "word", str(rng.randrange(10**6))]) for _ in range(200))
        codes = pool.codes(text)
        pool.learn()
        assert pool.tokens(codes, np.cumsum(pool.sizes[codes]) - pool.sizes[codes])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        pool.trim(20)
        assert len(pool.code) == len(pool.counts) == 20


def plain_alignment(rows, tokenizer, model):
    letter = {c: b for b, c in enumerate(vocabularies._byte_letters())}
    tokenizer.encode_special_tokens = True
    docs, count = [], defaultdict(int)
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = model.encode(text)
            a_bytes = [bytes(letter[c] for c in tokenizer.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(model.id_to_piece, b))]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 300 else running(parts)
                a_ends, b_ends = ends(a_bytes), ends(b_bytes)
                cuts = sorted(set(a_ends) & set(b_ends))
                i = j = 0
                for c in cuts:
                    i2, j2 = i, j
                    while i2 < len(a) and a_ends[i2] <= c:
                        i2 += 1
                    while j2 < len(b) and b_ends[j2] <= c:
                        j2 += 1
                    groups.append((a[i:i2], b[j:j2]))
                    i, j = i2, j2
                links = [(x, y) for x_, y_ in groups for x in x_ for y in y_]
        for pair in set(links):
            count[pair] += 1
        docs.append((doc_id, groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)))
    return sorted(out, key=str), {(x, y, n, n == best[x]) for (x, y), n in count.items()}


def running(parts):
    out, total = [], 0
    for p in parts:
        total += len(p)
        out.append(total)
    return out


@pytest.mark.parametrize("characters,links", [(50_000, 100), (alignment.CHARACTERS, alignment.LINKS)])
def test_alignment_equals_plain_version(spark, tokenizer, model, characters, links):
    texts = [t for t in odd_texts() if not t or len(t) < 200_000]
    docs, rows = table(spark, texts)
    made, pairs = alignment.align(docs, block_characters=characters, links=links)
    want, want_pairs = plain_alignment(rows, tokenizer, model)
    assert sorted([tuple(r) for r in made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()], key=str) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    empty, none = alignment.align(docs.filter("doc_id = -5"))
    assert empty.collect() == [] and none.collect() == []
