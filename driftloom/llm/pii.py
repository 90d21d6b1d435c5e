"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns give spans that always stay. The field then labels the tokens of a document that hold a
digit, an @ or a +: neighbouring ones share chain potentials, and tokens that are equal or similar (the same
letters and digits, the same digits, the same part before the @) share skip potentials however far apart they
are. The tokens of a kind of likeness link to hubs, the first one that the base patterns know of each label or
else the first one, so any two are at most two links apart and links grow with the tokens, not with their pairs.
Loopy sum-product passes carry labels along both until they settle, so what is personal data in one place
becomes so in the others. Token, chain and skip weights are fitted together on a bounded sample of the corpus.

Secrets, values that are assigned to a name like token or password, are found by a pattern and kept apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
N = len(KINDS) + 1  # label 0: none
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET_VALUE = re.compile(r"[=:][\x20]{0,4}[\"']?([A-Za-z0-9/+_-]{20,})")
SECRET_NAME = re.compile(r"(?i:token|secret|passw(?:or)?d|api[_-]?key|private[_-]?key|access[_-]?key)[\x20]{0,4}\Z")
SIGN = re.compile(r"[0-9@+][^\x20\x09-\x0D]*+")
SPACE = frozenset(" \t\n\x0b\f\r")
EDGES = ".,;:!?()[]{}\"'|<>#*$%&"
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern. Each @ is looked at once, with the run of name characters before it, so
    long runs without an @ cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers: in a dotted run, each four in a row, all at most 255."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values of at least 20 letters, digits, /, +, _ or - with a digit among them that are assigned to a secret's name."""
    for m in SECRET_VALUE.finditer(text):
        if any(c.isdigit() for c in m[1]) and SECRET_NAME.search(text, max(0, m.start() - 20), m.start()):
            yield m.span(1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) by kind, then start."""
    out = []
    for label, find, sign in ((1, emails, "@"), (2, addresses, "."), (3, cards, None), (4, phones, "+")):
        if sign is None or sign in text:
            out += [(label, a, b) for a, b in find(text)]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit, @ or +, without punctuation at their ends."""
    out, low = [], 0
    for m in SIGN.finditer(text):
        start = m.start()
        while start > low and text[start - 1] not in SPACE:
            start -= 1
        low, end = m.end(), m.end()
        while start < end and text[start] in EDGES:
            start += 1
        while start < end and text[end - 1] in EDGES:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    words = [text[a:b] for a, b in spans]
    near = [i > 0 and spans[i][0] - spans[i - 1][1] <= 3 for i in range(len(spans))]
    rows = np.zeros((len(spans), 20), dtype=np.float32)
    for i, w in enumerate(words):
        digits = "".join(filter(str.isdigit, w)) if len(w) < 200 else ""
        size = (0, 1, 4, 8, 12, 16, 20)
        rows[i, max(k for k, s in enumerate(size) if len(digits) >= s)] = 1
        rows[i, 7] = "@" in w
        rows[i, 8] = "." in w.partition("@")[2]
        rows[i, 9] = w.count(".") == 3 and len(digits) + 3 == len(w)
        rows[i, 10] = w[0] == "+"
        rows[i, 11] = "-" in w
        rows[i, 12] = len(digits) == len(w)
        rows[i, 13] = 16 <= len(digits) <= 19 and digits.isascii() and luhn(digits)
        rows[i, 14] = near[i] and words[i - 1][0] == "+"
        rows[i, 15] = near[i] and near[i - 1] and words[i - 2][0] == "+"
        rows[i, 16] = any(c.isalpha() for c in w[:200])
        rows[i, 17] = near[i]
        rows[i, 18] = i + 1 < len(spans) and near[i + 1]
        rows[i, 19] = 1
    return rows


def skip_links(text: str, spans: list[tuple[int, int]], known: np.ndarray) -> list[tuple[int, int]]:
    """(earlier token, token) between the tokens of at least 6 letters and digits that are equal or similar and the
    hubs of their kind: the first token of each label under the base spans (`known`), the first token if none has one."""
    alike: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(spans):
        w = text[a:b].lower()
        bare = "".join(filter(str.isalnum, w))
        digits = "".join(filter(str.isdigit, w))
        for key in {f"w{bare}" if len(bare) >= 6 else "", f"d{digits}" if len(digits) >= 6 else "", f"u{w.partition('@')[0]}" if "@" in w or len(bare) >= 6 else ""} - {""}:
            alike.setdefault(key, []).append(i)
    links = set()
    for own in alike.values():
        first: dict[int, int] = {}
        for i in own:
            first.setdefault(int(known[i]), i)
        for hub in [i for label, i in first.items() if label] or own[:1]:
            links.update((min(i, hub), max(i, hub)) for i in own if i != hub)
    return sorted(links)


@dataclass
class Field:
    """Weights of the field: features by label, chain and skip potentials (log)."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros((20, N)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((N, N)))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((N, N)))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def observed(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each token under the base spans."""
    labels = np.zeros(len(spans), dtype=np.int64)
    starts = np.array([a for a, _ in spans])
    ends = np.array([b for _, b in spans])
    for label, a, b in base:
        labels[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = label
    return labels


def chain_links(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(i - 1, i) for i in range(1, len(spans)) if spans[i][0] - spans[i - 1][1] <= 3]


def fit_texts(texts: list[str], steps: int = 400, hidden: float = 0.5, prior: float = 4.0, strength: float = 20.0, seed: int = 0) -> Field:
    """Weights from texts labelled by their base spans: token, chain and skip weights together, by the pseudo-likelihood
    of each label given its features and its neighbours' labels.

    The base patterns tell a token's label by its looks alone, which would leave the links nothing to explain. So a
    share `hidden` of the tokens is seen without its features: these must be told by their neighbours. The prior of the
    skip weights says that like tokens agree (mean `prior` on the diagonal), with the weight of `strength` tokens."""
    xs, ys, chains, skips, n = [], [], [], [], 0
    for text in texts:
        spans = tokens(text)
        if spans:
            labels = observed(spans, base_spans(text))
            xs.append(features(text, spans))
            ys.append(labels)
            chains += [(i + n, j + n) for i, j in chain_links(spans)]
            skips += [(i + n, j + n) for i, j in skip_links(text, spans, labels)]
            n += len(spans)
    model = Field(skip=prior * np.eye(N))
    if not xs:
        return model
    x, y = np.concatenate(xs).astype(np.float64), np.concatenate(ys)
    unseen = np.random.default_rng(seed).random(len(x)) < hidden
    x[unseen, :-1] = 0.0
    goal = np.eye(N)[y]
    ahead = np.zeros((len(x), N))  # labels of the neighbours: before, after and alike
    after, alike = ahead.copy(), ahead.copy()
    for (i, j), (one, other) in [(link, (ahead, after)) for link in chains] + [(link, (alike, alike)) for link in skips]:
        one[j] += goal[i]
        other[i] += goal[j]
    w, chain, skip = np.zeros((x.shape[1], N)), np.zeros((N, N)), prior * np.eye(N)
    # Steps are divided by how often a weight is used, as hubs have many neighbours.
    scale = [np.maximum(np.abs(m).sum(0).max() / len(x), 1.0) for m in (ahead, after, alike)]
    for _ in range(steps):
        rest = goal - np.exp(_log_softmax(x @ w + ahead @ chain + after @ chain.T + alike @ skip))
        w += 2.0 * (x.T @ rest / len(x) - 1e-4 * w)
        chain += (ahead.T @ rest + (after.T @ rest).T) / len(x) / max(scale[:2]) - 1e-3 * chain
        step = alike.T @ rest
        skip += ((step + step.T) / 2 - strength * (skip - prior * np.eye(N))) / (len(x) + strength) / scale[2]
    model.unary, model.chain, model.skip = w, chain, skip
    return model


def beliefs(unary: np.ndarray, links: np.ndarray, kinds: np.ndarray, potentials: np.ndarray, rounds: int = 6, still: float = 1e-3, most: int = 200) -> np.ndarray:
    """Label log probabilities of each token after damped loopy sum-product passing: `rounds` at least, then until no
    message moves by more than `still`. Loops that never settle end after `most`.

    links: (m, 2) token numbers; kinds: (m,) which of the potentials (k, N, N), by label of the first and second token,
    a link has. Memory grows by a few hundred bytes a link."""
    if not len(links):
        return _log_softmax(unary)
    src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    pots = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    kind = np.concatenate([kinds, kinds + len(potentials)])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    messages, new = np.zeros((len(src), N)), np.zeros((len(src), N))
    for done in range(1, most + 1):
        total = unary.copy()
        np.add.at(total, dst, messages)
        for lo in range(0, len(src), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            out = (total[src[part]] - messages[back[part]])[:, :, None] + pots[kind[part]]
            top = out.max(1)
            new[part] = _log_softmax(top + np.log(np.exp(out - top[:, None, :]).sum(1)))
        moved = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if done >= rounds and moved <= still:
            break
    total = unary.copy()
    np.add.at(total, dst, messages)
    return _log_softmax(total)


def find(texts: list[str], model: Field, sure: float = 0.95) -> list[list[tuple[int, int, int, bool]]]:
    """(label, start, end, base) of every span of every text, by kind and start. The texts of a batch share one
    message passing; links never cross texts."""
    base, spans, unary, links, kinds, first = [], [], [], [], [], [0]
    for text in texts:
        found = base_spans(text)
        own = tokens(text)
        base.append(found)
        spans.append(own)
        if own:
            known = observed(own, found)
            u = features(text, own) @ model.unary
            u[known > 0] = -20.0
            u[known > 0, known[known > 0]] = 20.0
            unary.append(_log_softmax(u))
            for kind, pairs in enumerate((chain_links(own), skip_links(text, own, known))):
                links += [(i + first[-1], j + first[-1]) for i, j in pairs]
                kinds += [kind] * len(pairs)
        first.append(first[-1] + len(own))
    if not unary:
        return [[(k, a, b, True) for k, a, b in found] for found in base]
    belief = beliefs(np.concatenate(unary), np.array(links, dtype=np.int64).reshape(-1, 2), np.array(kinds, dtype=np.int64), np.array([model.chain, model.skip]))
    best, score = belief.argmax(1), np.exp(belief.max(1))
    out = []
    for text, found, own, at in zip(texts, base, spans, first):
        rows = [(k, a, b, True) for k, a, b in found]
        if own:
            known = observed(own, found)
            for i, (a, b) in enumerate(own):
                label = int(best[at + i])
                if known[i] == 0 and label and score[at + i] >= sure:
                    same = rows and not rows[-1][3] and rows[-1][0] == label == 4 and a - rows[-1][2] <= 3
                    rows[-1:] = [(4, rows[-1][1], b, False)] if same else rows[-1:] + [(label, a, b, False)]
        out.append(sorted(rows, key=lambda r: (r[0], r[1])))
    return out


def fit(docs: DataFrame, sample: int = 1000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Weights fitted on about `sample` (at most twice as many) documents of at most `longest` characters that hold a
    digit, an @ or a +: those whose hash of id and text is below sample / number of such documents, so that reruns
    agree and tasks send the driver nothing but the sample."""
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    rows = rows.filter(F.col("text").rlike("[0-9@+]") & (F.length("text") <= longest))
    share = sample / max(rows.count(), 1)
    if share < 1:
        rows = rows.filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    return fit_texts([r.text for r in rows.limit(2 * sample).sort("h", "text").collect()])


def slices(batch: pa.RecordBatch, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and, but for single longer texts, `chars` characters (column 1)."""
    lo = held = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
        if i > lo and (i - lo >= rows or held + n > chars):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def personal_data(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, `spans`, all spans by kind and start (code points, end exclusive), and `secrets`,
    the (start, end) of values that are assigned to a name like token, key or password.

    Null text counts as empty and has no spans; repeated rows are each searched; an empty table gives an empty
    result; other columns are not looked at. A task holds the tokens and links of a quarter of a million characters, or
    of one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 500, 1 << 18):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [[{"kind": KINDS[k - 1], "start": a, "end": b, "base": known} for k, a, b, known in r] for r in find(texts, model)]
                hidden = [[{"start": a, "end": b} for a, b in secrets(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind), pa.array(hidden, pair)], names=[id_col, "spans", "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans {SPAN}, secrets array<struct<start:int,end:int>>")


def op6_skip_chain_pii(spark, sf_dir: str) -> DataFrame:
    """All documents; a null text has no spans."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"), F.size("secrets").cast("long").alias("n_secret"),
                        (F.size("spans") + F.size("secrets")).cast("long").alias("n_found"))
