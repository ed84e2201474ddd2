"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

The patterns (email, IP address, card and phone number) give the base spans.  Every other
mention that looks like one of them (a run of 6 to 19 digits with the usual separators, a word
around an ``@``, a spelled-out address) is a node without a label yet.  All nodes of a
document form one graph:

* unary potentials: a log-linear model over a mention's shape and its neighbouring words;
* chain potentials between neighbouring mentions;
* skip potentials between mentions, however far apart, that repeat the same digits, end in the
  same seven digits, or spell the same address: all of them are tied to one shared node, so evidence
  at one reaches every other in two steps and many repeats cost no more than their number.

All three are fitted together to the base labels of a bounded sample (``SAMPLE`` documents with mentions, by hash of
the text, and their first ``_MENTIONS`` mentions).  Base spans are observed.  Loopy belief propagation (damped, until the messages settle) gives the
marginals; mentions that are tied go by their shared node's, so their labels agree across the document, and an open one
becomes a span when one kind's marginal passes ``THRESHOLD``.  Base spans always stay, and added ones
never overlap them.

Defined cases: null and empty texts have no spans; texts are read whole, in time linear in
their length; ties between kinds go to the one listed first; repeated rows are answered
each; null ids are kept; other columns are ignored; an empty table gives no row; without
any mention to learn from, only base spans are returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_slices, pick, replace

KINDS = ("email", "ip", "card", "phone")
#: Documents whose mentions are fitted; widest gap at which mentions are chain neighbours.
SAMPLE = 4000
THRESHOLD = 0.9
#: Messages are passed until none moves by more than SETTLED, at most ROUNDS times (a field that doesn't settle by then is damped
#: enough to be read).
ROUNDS, SETTLED = 200, 1e-4
#: What equal mentions' agreement is worth before anything is learned.
AGREEMENT = 8.0
_FEATURES = 1 << 12

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: All digits, blanks, dots, dashes and brackets that follow a digit or plus: numbers of any kind lie inside.
_REGION = re.compile(r"[+0-9][\x20().0-9-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_AT_WORD = re.compile(r"[^\s<>\"'(),;]{1,64}\Z"), re.compile(r"[^\s<>\"'(),;]{1,255}")
_SPELLED = re.compile(r"\b[\w.+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[\w-]{1,63}"
                      r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[\w-]{1,63})+", re.I)
_WORD_BEFORE = re.compile(r"[^\W\d_]+(?=[^\w]*\Z)")
_WORD_AFTER = re.compile(r"[\W\d_]*([^\W\d_]+)")


def passes_luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    for r in _REGION.finditer(text):
        a, b = r.span()
        if b - a < 7:
            continue
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text, a, b)
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text, a, b)
                if 12 <= len(d := _digits(m[0])) <= 19 and passes_luhn(d)]
        if text[a] == "+":
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text, a, b) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def open_mentions(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans that look like personal data but match no pattern; none overlaps a base span or another."""
    found = []
    for r in _REGION.finditer(text):
        if r.end() - r.start() >= 6:
            for m in _NUMBER.finditer(text, r.start(), r.end()):
                if 6 <= len(_digits(m[0])) <= 19:
                    opened = ")" in m[0] and "(" not in m[0] and m.start() > 0 and text[m.start() - 1] == "("
                    found.append((m.start() - opened, m.end()))
    at = text.find("@")
    while at >= 0:
        left, right = _AT_WORD[0].search(text, max(0, at - 64), at), _AT_WORD[1].match(text, at + 1)
        if left and right:
            found.append((left.start(), right.end()))
        at = text.find("@", at + 1)
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    if any(x in low for x in (" dot ", "[dot]", "(dot)")):
        found += [m.span() for m in _SPELLED.finditer(text)]
    out, taken, k = [], -1, 0
    spans = sorted((a, b) for a, b, _ in base)
    for a, b in sorted(found):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if a >= taken and not (k < len(spans) and spans[k][0] < b):
            out.append((a, b))
            taken = b
    return out


def _bucket(*parts) -> int:
    return xxhash.xxh32_intdigest("\x00".join(map(str, parts))) % _FEATURES


def features(text: str, a: int, b: int) -> list[int]:
    """Hashed features of a mention: its shape and neighbouring words (the plus sign is left out on purpose,
    so that a number written without it can still look like a phone number)."""
    s = text[a:b]
    d = _digits(s)
    before, after = _WORD_BEFORE.search(text, max(0, a - 30), a), _WORD_AFTER.match(text, b, b + 30)
    glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    marks = "".join(sorted({c for c in s if not c.isalnum() and c != "+"}))
    return [_bucket("bias"), _bucket("digits", len(d)), _bucket("marks", marks), _bucket("glued", glued),
            _bucket("at", "@" in s), _bucket("dots", min(s.count("."), 4)),
            _bucket("luhn", 12 <= len(d) <= 19 and passes_luhn(d)),
            _bucket("shape", re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", s.lstrip("+")))[:24]),
            _bucket("before", before[0].lower() if before else ""), _bucket("after", after[1].lower() if after else "")]


def skip_keys(s: str) -> list[str]:
    """What a mention must share with another for a skip edge."""
    d = _digits(s)
    if "@" in s or re.search(r"\bat\b|\[at\]|\(at\)", s, re.I):
        plain = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", re.sub(r"\s*[\[(]?\bat\b[\])]?\s*", "@", s.lower()))
        return ["a" + plain]
    return (["d" + d, "t" + d[-7:]] if len(d) >= 7 else ["d" + d]) if len(d) >= 6 else []


def graph(text: str):
    """(spans, label numbers with -1 for open, chain edges, groups) of a text's mentions.

    ``groups`` numbers the mentions so that those that share a key, directly or through others, have one number: they are
    tied to one shared node.
    """
    base = base_spans(text)
    nodes = [(a, b, KINDS.index(k) + 1) for a, b, k in base]
    nodes += [(a, b, -1) for a, b in open_mentions(text, base)]
    nodes.sort()
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    group = list(range(len(nodes)))

    def root(i):
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    first: dict[str, int] = {}
    for i, (a, b, _) in enumerate(nodes):
        for key in skip_keys(text[a:b]):
            j = root(first.setdefault(key, i))
            group[max(root(i), j)] = min(root(i), j)
    return nodes, chain, [root(i) for i in range(len(nodes))]


class Field:
    """Potentials of the random field: unary weights, and log affinities of label pairs along chain and skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base spans, added spans) of a text."""
        if not text:
            return [], []
        nodes, chain, group = graph(text)
        base = sorted(((a, b, KINDS[k - 1]) for a, b, k in nodes if k > 0), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
        if all(k > 0 for *_, k in nodes):
            return base, []                      # nothing left to decide
        # a mention goes by its shared node: equal mentions get one label
        marginal = self.marginals(text, nodes, chain, group)
        added = [(a, b, KINDS[best]) for (a, b, k), p in zip(nodes, marginal)
                 if k < 0 and p[1 + (best := int(np.argmax(p[1:])))] >= THRESHOLD]
        return base, added

    def marginals(self, text, nodes, chain, group) -> np.ndarray:
        """Of each mention's shared node (its own where nothing is shared), by loopy message passing until it settles."""
        n_labels = len(KINDS) + 1
        unary = np.array([self.weights[:, features(text, a, b)].sum(1) if k < 0 else np.where(np.arange(n_labels) == k, 0.0, -30.0)
                          for a, b, k in nodes])
        shared, at, many = np.unique(np.array(group), return_inverse=True, return_counts=True)
        # a shared node for every group of several; mentions that share nothing speak for themselves
        hub = np.where(many > 1, len(nodes) + np.cumsum(many > 1) - 1, shared)[at]
        tied = np.flatnonzero(hub >= len(nodes))
        unary = np.concatenate([unary, np.zeros((int((many > 1).sum()), n_labels))])
        skip = np.stack([tied, hub[tied]], 1)
        if not chain and not len(skip):
            return _softmax(unary)[hub]
        edges = np.concatenate([np.array(chain, np.int64).reshape(-1, 2), skip])
        table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        # messages run both ways along every edge: the second half are the reversed ones
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg = np.zeros((len(src), n_labels))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(out - top).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if moved < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief)[hub]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_field(sample: list[tuple[list[list[int]], list[int], list[list[int]], list[list[int]]]], steps: int = 300, rate: float = 0.5,
              decay: float = 1e-3) -> Field:
    """Unary, chain and skip weights, fitted together to (features of each mention, labels, chain edges, skip edges) of some
    documents; labels are 0 for an open mention and -1 for one that repeats a found one.

    The pseudo-likelihood of each mention's label given its neighbours' is raised.  What an open mention is isn't known for
    certain, so it never counts for a pair's weight, and one that repeats a found mention for none at all: repeats that no
    pattern finds teach neither that equal mentions differ nor that they look like none.  Skip weights are drawn
    towards agreement, and no label's pair is observed with "none", which gets what the others have on average.
    """
    n_labels = len(KINDS) + 1
    rows = [f for feats, *_ in sample for f in feats]
    labels = np.array([y for _, ys, *_ in sample for y in ys], np.int64)
    w = np.zeros((n_labels, _FEATURES))
    agree = AGREEMENT * np.eye(n_labels)
    if not rows:
        w[0, _bucket("bias")] = 10.0           # nothing to learn from: all open mentions stay open
        return Field(w, np.zeros((n_labels, n_labels)), agree)
    x = np.array(rows, np.int64)
    truth = np.eye(n_labels)[np.maximum(labels, 0)]
    starts = np.cumsum([0, *(len(ys) for _, ys, *_ in sample)])
    pairs = []
    for which in (0, 1):
        found = np.array([(i + s, j + s) for s, (_, _, *edges) in zip(starts, sample) for i, j in edges[which]], np.int64).reshape(-1, 2)
        found = found[(labels[found] > 0).all(1)]
        pairs.append(np.concatenate([found, found[:, ::-1]]))
    prior = (np.zeros((n_labels, n_labels)), agree)
    tables = [p.copy() for p in prior]
    for _ in range(steps):
        logits = w[:, x].sum(2).T
        for table, both in zip(tables, pairs):
            np.add.at(logits, both[:, 0], table[:, labels[both[:, 1]]].T)
        miss = np.where(labels[:, None] < 0, 0.0, _softmax(logits) - truth)
        grad = np.zeros_like(w)
        for k in range(n_labels):
            grad[k] = np.bincount(x.ravel(), np.repeat(miss[:, k], x.shape[1]), _FEATURES) / len(x)
        w -= rate * (grad + decay * w)
        for t, (table, both) in enumerate(zip(tables, pairs)):
            if len(both):
                step = np.zeros((n_labels, n_labels))
                np.add.at(step.T, labels[both[:, 1]], miss[both[:, 0]])
                table -= rate * ((step + step.T) / 2 / len(x) + decay * (table - prior[t]))
    for table in tables:
        kinds = np.arange(1, n_labels)
        same = table[kinds, kinds].mean()
        other = (table[1:, 1:].sum() - table[kinds, kinds].sum()) / max(len(kinds) * (len(kinds) - 1), 1)
        table[0, :] = table[:, 0] = other
        table[0, 0] = same
    # a shared node never speaks for another label than its mentions'
    skip = tables[1] - np.minimum(0.0, np.diag(tables[1]) - tables[1].max(1))[:, None] * np.eye(n_labels)
    return Field(w, tables[0], skip)


_TRAIN = pa.schema([("h", pa.int64()), ("features", pa.list_(pa.list_(pa.int32()))), ("labels", pa.list_(pa.int32())),
                    ("chain", pa.list_(pa.list_(pa.int32()))), ("skip", pa.list_(pa.list_(pa.int32())))])
_TRAIN_SQL = "h long, features array<array<int>>, labels array<int>, chain array<array<int>>, skip array<array<int>>"
#: Mentions of one document that are fitted at most (the sample's bound is SAMPLE times this).
_MENTIONS = 64


def learn_field(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted to the base labels of ``sample`` documents, taken by hash of their text."""
    def make():
        def run(cols):
            for (text,) in zip(*cols):
                nodes, chain, group = graph(text) if text else ([], [], [])
                if nodes:
                    few = nodes[:_MENTIONS]
                    inside = lambda edges: [[i, j] for i, j in edges if j < len(few)]
                    # an open mention is none, unless it repeats a found one: then it isn't known
                    known = {g for g, (*_, k) in zip(group, nodes) if k > 0}
                    labels = [k if k > 0 else -1 if g in known else 0 for g, (*_, k) in zip(group, nodes)]
                    # two kinds' spans of one number are no two mentions of it
                    last: dict[int, int] = {}
                    skip = [(j, i) for i, g in enumerate(group) if nodes[j := last.setdefault(g, i)][1] <= nodes[i][0]]
                    chain = [(i, j) for i, j in chain if nodes[i][1] <= nodes[j][0]]
                    yield (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1,
                           [features(text, a, b) for a, b, _ in few], labels[:_MENTIONS], inside(chain), inside(skip))
        return run

    rows = map_rows(pick(docs, "text"), make, _TRAIN, _TRAIN_SQL, weigh=lambda r: 512 * len(r[2]))
    got = rows.dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    return fit_field([(r.features, r.labels, r.chain, r.skip) for r in got])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("added", pa.list_(_SPAN))])
_FOUND_SQL = ("doc_id long, base array<struct<kind: string, start: long, end: long>>, "
              "added array<struct<kind: string, start: long, end: long>>")


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and added spans (kind, start, end in code points) of every document."""
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]

    def make():
        def run(cols):
            for doc, text in zip(*cols):
                base, added = field.spans(text)
                yield doc, as_rows(base), as_rows(added)
        return run

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, make, _FOUND, _FOUND_SQL, weigh=lambda r: 64 + 64 * (len(r[1]) + len(r[2])))


def mask(text: str | None, field: Field) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    base, added = field.spans(text)
    out, at = [], 0
    for a, b, kind in sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows with personal data masked in text, and n_chars counted anew; other columns as they are."""
    field = learn_field(docs)
    text_at, size_at = docs.columns.index("text"), docs.columns.index("n_chars")

    def make():
        def run(b):
            masked = [mask(t, field) for t in b.column(text_at).to_pylist()]
            return replace(replace(b, text_at, masked), size_at, [None if t is None else len(t) for t in masked])
        return run

    return map_slices(docs, make)
