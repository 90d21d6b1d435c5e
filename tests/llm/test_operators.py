"""Mixing, packing, chat formatting, personal data, archives, quality rules and the pipeline against plain versions."""

import itertools
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.llm import chat_format, mixing, packing, pii, quality_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORD.findall(text or ""))


# -- mixing --------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, share, most):
    """Targets by sharing the excess anew until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_meets_its_targets(documents, rows):
    docs, slices = mixing.mix(documents)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += n_words(text)
    targets = water_fill(sizes, (5, 2, 1), 1.5, 2.0)
    found = {r.source: r for r in docs.select("source", "source_size", "target", "rank").distinct().collect()}
    assert {s: r.source_size for s, r in found.items()} == dict(sizes)
    assert all(abs(found[s].target - targets[s]) < 1e-6 for s in sizes)
    taken = {r["rank"]: r.n for r in slices.groupBy("rank").agg(F.sum("length").alias("n")).collect()}
    assert all(abs(taken.get(r["rank"], 0) - r.target) <= max(30, 0.03 * r.target) for r in found.values())
    per = slices.groupBy("rank", "start").agg(F.sum("length").alias("n")).join(docs.filter("size > 0"), ["rank", "start"])
    assert per.filter("n > 2 * size").isEmpty()
    assert slices.filter("first < 0 or length <= 0").isEmpty()


def test_mix_keeps_small_sources(spark):
    """Sources below and of a few blocks meet their targets, and so do all when blocks reach their largest size."""
    sizes = {"big": 40_000, "large": 20_000, "tiny": 1, "short": 37, "few": 400, "some": 3000}
    rows = [(len(s) * 1000 + i, "w " * min(50, n - i * 50), s) for s, n in sizes.items() for i in range(-(-n // 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = water_fill(sizes, (5, 2, 1), 1.5, 2.0)
    for options in ({"slots": 64}, {"slots": 64, "largest": 20}):
        docs, slices = mixing.mix(df, **options)
        name = {r["rank"]: r.source for r in docs.select("rank", "source").distinct().collect()}
        taken = {name[r["rank"]]: r.n for r in slices.groupBy("rank").agg(F.sum("length").alias("n")).collect()}
        assert all(abs(taken.get(s, 0) - targets[s]) <= 1 + 0.02 * targets[s] for s in sizes), (taken, targets)
        assert slices.select("slot").distinct().count() == slices.select("slot", "rank").distinct().count()  # one owner a slot
        exact = {s: round(t) for s, t in targets.items()}
        assert {s: taken.get(s, 0) for s in sizes} == exact
    assert docs.first().b == 20
    assert {r.source for r in mixing.mixed_documents(df, slots=64).select("source").distinct().collect()} == set(sizes)


def test_points_of_any_slot(spark):
    slots = [0, 1, 2, (1 << 32) - 1, 1 << 32, (1 << 40) + 12345, (1 << 59) + 7]
    found = spark.createDataFrame([(i,) for i in slots], "slot long").select("slot", mixing.golden_point(F.col("slot")).alias("u")).collect()
    assert all(r.u == r.slot * mixing.GOLDEN % (1 << 60) for r in found) and mixing.GOLDEN % 2 == 1
    assert abs(mixing.GOLDEN / (1 << 60) - (5**0.5 - 1) / 2) < 1e-15


def test_mix_prefixes_are_balanced(documents):
    docs, slices = mixing.mix(documents)
    goal = {r["rank"]: r.target for r in docs.select("rank", "target").distinct().collect()}
    early = slices.filter("slot < 5000").groupBy("rank").agg(F.sum("length").alias("n")).collect()
    total, everything = sum(r.n for r in early), sum(goal.values())
    assert all(abs(r.n / total - goal[r["rank"]] / everything) < 0.01 for r in early)


def test_mix_reruns_and_edges(documents, empty, spark):
    first, again = (Counter(map(tuple, mixing.mix(documents)[1].collect())) for _ in range(2))
    assert first == again
    assert mixing.mix(empty)[0].count() == 0 and mixing.mix(empty)[1].count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    docs, slices = mixing.mix(blank)
    assert docs.count() == 2 and slices.isEmpty() and docs.agg(F.sum("target")).first()[0] == 0
    assert mixing.mixed_documents(documents).columns == documents.columns


# -- packing -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return t


def test_packing_round_trip(documents, rows, empty, tokenizer):
    pieces = packing.pack(documents).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, *_ in rows)
    got = Counter()
    for doc_id, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        copies = sum(p.start == 0 for p in own)
        ids = [memoryview(bytes(p.ids)).cast("I").tolist() for p in own[::copies]]
        got[doc_id, tuple(x for part in ids for x in part)] += copies
    assert set(got) == set(want)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert packing.pack(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ranks_encode_as_the_tokenizer(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for x in (text, text * 3, "<|endoftext|>" + text, " " + text + "\n\n "):
        x = x.encode("utf-8", "ignore").decode()
        assert packing.encoder().encode(x, allowed_special="all") == t.encode(x, add_special_tokens=False).ids


def test_special_strings_are_special_tokens(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n\n  y", "<|endoftext", "<|im_end|> é<|endoftext|>é"]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "start").collect()
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id] += memoryview(bytes(p.ids)).cast("I").tolist()
        assert p.doc_tokens == len(t.encode(texts[p.doc_id], add_special_tokens=False).ids) + 1
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids + [0] for i, x in enumerate(texts)) and 50256 in got[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_balance_fills_every_sequence(lengths):
    used, covered = defaultdict(int), defaultdict(int)
    for item, start, n, to, offset in packing.balance(lengths, 64, 1.0, 0.1):
        assert start == covered[item] and offset == used[to] and n > 0
        covered[item] += n
        used[to] += n
    assert all(covered[i] == n for i, n in enumerate(lengths))
    assert all(n <= 64 and n & (n - 1) == 0 for n in used.values())


def test_balance_evens_the_cost():
    rng = random.Random(1)
    lengths, cost = [rng.randint(1, 1000) for _ in range(500)], defaultdict(float)
    for _, _, n, to, _ in packing.balance(lengths, 1024, 1.0, 1 / 1024):
        cost[to] += n + n * n / 1024
    whole = sorted(cost.values())[10:]
    assert whole[-1] / whole[len(whole) // 2] < 1.4


def test_very_long_runs():
    for text in ("a" * 200_000, " " * 50_000, "é" * 50_000):
        assert len(packing.encoder().encode_ordinary(text)) > 100


# -- chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "&lt;|im_end|>", "a &amp; b &#10;", "\n", "", None, "<|", "|>", "日本語 & more"]
    rows = [(c, t, role, text, 0) for c in range(3) for t, text in enumerate(texts) for role in ("user", "assistant", "tool\nwith &line", None)] + [(None, 0, "user", "x", 0), (5, None, "assistant", "y", 0), (5, None, "assistant", "y", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(df))).collect()}
    for conv in (0, 1, 2, None, 5):
        key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
        own = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(x.role, x.text) for x in out[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert out[conv].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
        escaped = [(r[3] or "").replace("&", "&amp;").replace("<|", "&lt;|") for r in own if r[2] == "assistant"]
        assert [out[conv].formatted[s.start : s.start + s.length] for s in out[conv].loss] == escaped
    assert chat_format.format_turns(chat_format.canonical_turns(df.filter("conv_id = 99"))).count() == 0
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string").schema
    assert chat_format.BY_FINGERPRINT[chat_format.fingerprint(chat_format.field_paths(table))] == "conversation_rows"


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "response": "a"},
        {"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "with", "output": "a"}, {"system": "s", "prompt": "q", "response": "a"}, {"unknown": 1}, {"prompt": "q"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "{no json"), (10, None)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat_format.canonical_records(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    two = [("user", "q"), ("assistant", "a")]
    assert all(got[i] == two for i in range(5)) and got[5] == [("user", "q\nwith"), ("assistant", "a")] and got[6] == [("system", "s"), *two]
    assert all(got[i] == [(None, None)] for i in (7, 8, 9, 10))
    flat = spark.createDataFrame([(1, "q", "a", 3)], "conv_id long, prompt string, completion string, other int")
    assert chat_format.layout_of(flat.schema) == "prompt_completion" and chat_format.canonical_turns(flat).count() == 2
    both = spark.createDataFrame([(1, "q", "a", "s", "t")], "conv_id long, prompt string, response string, system string, text string")
    assert chat_format.layout_of(both.schema) == "system_prompt_response"
    with pytest.raises(ValueError):
        chat_format.layout_of(spark.createDataFrame([(1,)], "x int").schema)


def test_layouts_with_nulls(spark):
    records = [
        {"messages": [{"role": "system", "content": None}, {"role": "user", "content": "q"}]}, {"prompt": "x", "response": None},
        {"prompt": "q", "response": None, "completion": "a"}, {"conversations": [{"from": "human"}, {"from": "gpt", "value": "a"}]}, {"messages": []}, 7,
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat_format.canonical_records(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {0: [("system", ""), ("user", "q")], 1: [("user", "x"), ("assistant", "")], 2: [("user", "q"), ("assistant", "a")],
                   3: [("user", ""), ("assistant", "a")], 4: [(None, None)], 5: [(None, None)]}
    lists = spark.createDataFrame([(1, None), (2, []), (3, [("user", "q")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert Counter(map(tuple, chat_format.canonical_turns(lists).collect())) == Counter([(1, None, None, None), (2, None, None, None), (3, 0, "user", "q")])


def test_fingerprints_select_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"q"}]}', '{"messages":[{"content":"a","role":"user"},{"role":"x","content":null}],"id":{"a":1}}', '{"messages":[{"role":"user","content":"q"}]}', '{"x":[1,2],"y":null}', "[]", '{"messages":[null]}', "{}"]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    out = {r.conv_id: r for r in chat_format.record_layouts(df).collect()}
    assert out[0].fingerprint == out[2].fingerprint == chat_format.fingerprint(["messages[].content", "messages[].role"]) and out[0].layout == "messages"
    assert out[1].paths == ["id.a", "messages[].content", "messages[].role"] and out[1].layout == "messages" and out[1].fingerprint != out[0].fingerprint
    assert out[3].paths == ["x[]", "y?"] and out[3].layout is None and out[4].paths is None
    assert sorted(r.conv_id for r in chat_format.unknown_records(df).collect()) == [3, 4, 6] and out[5].layout == "messages"


def test_deep_records_and_rejects(spark):
    part = lambda t, kind="text": {"type": kind, "text": t}
    records = [
        {"messages": [{"role": "user", "content": [part("hi "), part("there")]}, {"role": "assistant", "content": [part("yes")]}]},
        {"messages": [{"role": "user", "content": [part("see"), {"type": "picture", "at": {"url": "x"}}]}]},
        {"messages": [{"role": "user", "content": "q"}, "loose"]}, {"messages": [{"role": "user", "content": "q"}, None]}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [part("a")]}]},
        {"prompt": "q", "response": {"text": "a"}}, {"messages": [{"role": "user", "content": ["a", "b"]}]}, {"a": {"b": {"c": {"d": [{"e": 1}]}}}}, {"a": {"b": {"c": {"d": [{"f": 1}]}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat_format.canonical_records(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got[0] == [("user", "hi there"), ("assistant", "yes")] and got[1] == [("user", "see")]
    assert all(got[i] == [(None, None)] for i in range(2, 9))
    shapes = {r.conv_id: r for r in chat_format.record_layouts(df).collect()}
    assert shapes[0].fingerprint == chat_format.fingerprint(chat_format.LAYOUTS["message_parts"]["paths"]) and shapes[7].fingerprint != shapes[8].fingerprint
    assert sorted(r.conv_id for r in chat_format.unknown_records(df).collect()) == list(range(2, 9))
    table = spark.createDataFrame([(1, [("user", [("text", "a"), ("text", "b")])])], "conv_id long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [tuple(r) for r in chat_format.canonical_turns(table).collect()] == [(1, 0, "user", "ab")]


# -- personal data -------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")


def plain_spans(text):
    out = [(1, *m.span()) for m in EMAIL.finditer(text)]
    out += [(2, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((3, *m.span()))
    return out + [(4, *m.span()) for m in pii.PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+-( )90\n%Z_é4", max_size=70))
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(4)
    card = lambda: next(x for x in (str(rng.randrange(10**15, 10**16)) for _ in range(1000)) if pii.luhn(x))
    return pii.fit_texts([f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or a{k}.b@mail{k}.example.com from {k}.1.2.3 card {card()} id {rng.randrange(10**15)} in {k} days" for k in range(200)])


def test_known_tokens_carry_over(field):
    text = "write to jane.doe77@mail.example.com today. " + "filler words " * 300 + "jane.doe77@mail is the same person. Order 12 of 40."
    found = pii.find([text, "A clean text of 12 words, 3 numbers and 2024 no data.", ""], field)
    added = [text[a:b] for _, a, b, base in found[0] if not base]
    assert [s for s in found[0] if s[3]] == [(*s, True) for s in plain_spans(text)]
    assert added == ["jane.doe77@mail"] and found[1] == [] and found[2] == []


def test_known_tokens_carry_over_to_all_repeats(field):
    """Dozens of mentions in another form, with the base form first, in the middle or last."""
    full, bare = "jane.doe77@mail.example.com", "jane.doe77@mail"
    for place in (0, 20, 40):
        text = (" and some words between. ").join([bare] * place + [full] + [bare] * (40 - place))
        found = pii.find([text], field)[0]
        assert [text[a:b] for _, a, b, base in found if not base] == [bare] * 40
    known = np.zeros(41, dtype=np.int64)
    known[20] = 1
    text = " x ".join([bare] * 41)
    for labels, hub in ((known, 20), (np.zeros(41, dtype=np.int64), 0)):
        links = pii.skip_links(text, pii.tokens(text), labels)
        assert len(links) == 40 and all(hub in link for link in links)


def test_messages_pass_on_until_they_settle():
    """On a chain of 60 tokens beliefs are those of exact forward and backward sums."""
    rng = np.random.default_rng(3)
    unary, pot = rng.normal(size=(60, pii.N)), 4.0 * np.eye(pii.N)
    unary[0] = [-20, 20, -20, -20, -20]
    links = np.array([(i, i + 1) for i in range(59)])
    ahead, back = [unary[0]], [np.zeros(pii.N)]
    for i in range(1, 60):
        ahead.append(unary[i] + np.logaddexp.reduce(ahead[-1][:, None] + pot, axis=0))
        back.append(np.logaddexp.reduce((back[-1] + unary[60 - i])[None, :] + pot, axis=1))
    exact = np.array(ahead) + np.array(back[::-1])
    exact -= np.logaddexp.reduce(exact, axis=1)[:, None]
    got = pii.beliefs(unary, links, np.zeros(59, dtype=np.int64), np.array([pot]))
    assert np.abs(np.exp(got) - np.exp(exact)).max() < 0.01


def test_beliefs_equal_enumeration():
    """On small graphs without loops (a star with a chain) beliefs are the exact marginals; with one weak loop nearly so."""
    rng = np.random.default_rng(5)
    pots = rng.normal(size=(2, pii.N, pii.N))
    pots[1] = (pots[1] + pots[1].T) / 2
    for links, kinds, off in (([(0, 1), (0, 2), (0, 3), (3, 4)], [1, 1, 1, 0], 0.002), ([(0, 1), (1, 2), (0, 2)], [0, 0, 1], 0.08)):
        n, scale = max(max(x) for x in links) + 1, 1.0 if off < 0.01 else 0.3
        unary = rng.normal(size=(n, pii.N))
        exact = np.zeros((n, pii.N))
        for labels in itertools.product(range(pii.N), repeat=n):
            weight = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(scale * pots[kind][labels[i], labels[j]] for (i, j), kind in zip(links, kinds)))
            for i, k in enumerate(labels):
                exact[i, k] += weight
        exact /= exact.sum(1, keepdims=True)
        got = np.exp(pii.beliefs(unary, np.array(links), np.array(kinds), scale * pots, still=1e-6))
        assert np.abs(got - exact).max() < off


def test_fitted_field(field):
    """Like tokens agree in all labels, so a card number that stands twice in a row, which no base pattern takes, is known
    by the links to a distant mention; a clean text with repeated numbers stays clean."""
    assert (np.diag(field.skip) - (field.skip - 99 * np.eye(pii.N)).max(1) > 1).all()
    text = "Paid by 4111111111111111. " + "words " * 200 + "Cards 4111111111111111 4111111111111111, order 123-4567 of 42."
    added = [(k, text[a:b]) for k, a, b, base in pii.find([text], field)[0] if not base]
    assert added == [(3, "4111111111111111")] * 2
    assert pii.find(["Order 1234567 of 2024, again 1234567 and 1234567 in 2024 with 12 items."], field) == [[]]


def test_secrets_are_kept_apart(field):
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x; API_KEY: abcdefghijklmnopqrstuvwxyz; tokens = 12; password=Abc_def-0123456789xyz'
    assert [text[a:b] for a, b in pii.secrets(text)] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "Abc_def-0123456789xyz"]
    assert not list(pii.secrets("token" * 50_000))


def test_personal_data_table(documents, empty, spark, field):
    df = spark.createDataFrame([(1, "é 😀 mail a.b@c.de"), (None, None), (3, ""), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(df, field).collect()}
    assert got == {1: [("email", 9, 17)], None: [], 3: []}
    assert pii.personal_data(empty, field).count() == 0 and pii.personal_data(documents, pii.fit(documents)).count() == documents.count()
    pii.fit(empty)


def test_long_runs_stay_linear(field):
    for text in ("a" * 200_000, "1" * 200_000, "1." * 50_000, "+1" * 50_000, "@" * 100_000, "a@" * 50_000):
        pii.find([text], field)


# -- archives ------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "<p>é</p>", "", None, "x" * 300_000, "<p>é</p>", "a\r\n\r\nb", "WARC/1.1\r\n"] + [f"page {i}" for i in range(40)]
    rows = [(i, None if i == 6 else f"http://h/{i}\r\nX: y", h, 1) for i, h in enumerate(html)] + [(None, "u", "<p>é</p>", 1), (5, "again", "<p>é</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    index = warc.write_archive(pages, f"file://{tmp_path}/archive", file_bytes=2000)
    got = warc.read_records(index, max_gap=10, max_read=4000).collect()
    groups = defaultdict(list)
    for i, _, h, _ in rows:
        groups[h or ""].append(i)
    keep = {h: max((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    expected = Counter((i, len((h or "").encode()), warc.digest32((h or "").encode()), "response" if i == keep[h or ""] else "revisit", None if i == keep[h or ""] else keep[h or ""]) for i, _, h, _ in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert Counter(bytes(r.payload) for r in got if r.payload is not None)["<p>é</p>".encode()] == 2
    # A selection is read without the rest, and each file is a run of whole records.
    assert warc.read_records(index.filter("page_id = 4")).first().payload_bytes == 300_000
    for file in (tmp_path / "archive").iterdir():
        data = file.read_bytes()
        while data:
            z = zlib.decompressobj(31)
            warc.parse(z.decompress(data))
            data = z.unused_data
    assert warc.read_records(warc.write_archive(pages.filter("page_id = -1"))).count() == 0


# -- quality rules -------------------------------------------------------------------------------------------------


def measurements(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_ledger(documents, rows, empty, spark):
    extra = ["a b c " * 40, "a a a a", "a b c a b c", "x # y\n" * 30, "so it is. " * 60 + "\n" + "end", "é😀 " * 55]
    df = documents.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(1000 + i, t, 0) for i, t in enumerate(extra)], "doc_id long, text string, n int"))
    every = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(extra)]
    book = quality_rules.ledger(df).cache()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == Counter((i, *measurements(t)) for i, t in every)
    bits = {r.doc_id: r.fail_bits for r in book.collect()}
    assert bits[1000] & 2 and bits[1001] & 1 and bits[1005] & 2 and not bits[1004] & 1
    rows_of = {r.rule: r for r in quality_rules.ablations(book, "strict-1").collect()}
    assert rows_of["few_words"].fails == book.filter("n_words < 50").count() and rows_of["few_words"].alone == book.filter("fail_bits = 1").count()
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.ablations(quality_rules.ledger(empty), "base-1").first().fails == 0
    kept = quality_rules.keep_documents(documents, "strict-1")
    assert kept.columns == documents.columns and kept.count() == book.filter("fail_bits = 0 and doc_id < 1000 or doc_id is null and fail_bits = 0").count()


# -- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark, documents, rows, tokenizer, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import jaccard_classes

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), list(rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None

    def step(name, expected):
        nonlocal docs
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == documents.columns
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in expected)

    def good(text):
        n, chars, symbols, dup, rep = measurements(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        return n >= 50 and 100 * rep <= 50 * n and 2 * symbols <= n and 2 * n <= chars <= 25 * n and 2 * dup <= lines

    left = [r for r in left if good(r[1])]
    step("quality", left)
    best = {}
    for r in left:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    left = list(best.values())
    step("exact_dedup", left)
    heads = {c for _, c, _ in jaccard_classes(left)}
    left = [r for r in left if r[0] in heads]
    step("near_dedup", left)
    out = stages["mix"](spark, docs, str(tmp_path))
    out.write.parquet(f"{tmp_path}/mix")
    mixed = spark.read.parquet(f"{tmp_path}/mix")
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == documents.columns and set(times) <= {r[0] for r in left} and max(times.values()) <= 2 and sum(times.values()) > len(left)
    pieces = stages["pack"](spark, mixed, str(tmp_path)).collect()
    length = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in left}
    assert sum(p.length for p in pieces) == sum(length[i] * n for i, n in times.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_leaves_its_result_only(spark, documents, tmp_path):
    import corpus_pipeline
    from driftloom.llm.common import scratch

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    shared = os.path.dirname(scratch(spark, "x")).removeprefix("file://")
    os.makedirs(shared, exist_ok=True)
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and len(set(os.listdir(shared)) - before) == 1


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
