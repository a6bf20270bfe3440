"""Personal data in free text: a linear-chain conditional random field.

Tokens are described by their own shape and by what stands within three tokens;
the weights are fitted by gradient ascent on the likelihood of the small labelled
table of ``pii_examples``.  A token's part of every emission depends on the token
alone, so it is computed once per distinct token and gathered by index; Viterbi
runs over numpy batches of sequences.  Found spans pass an exact check of form,
which only trims or drops, and the text is given back as the reader sees it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_examples
from .markup import visible_text

KINDS = ("email", "phone", "national_id", "address", "person_name")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
_L = len(LABELS)
REACH = 3
_OFFSETS = 2 * REACH + 1
#: Parts of listed names are told by a hash of this many values, so that a list of any length takes the same room.
NAME_PARTS = 1 << 20
#: Listed names that fill slots of the training sentences: those of least hash, at most this many.
NAMES_IN_TRAINING = 1_000
#: Distinct tokens whose weights a worker keeps.
MEMO_TOKENS = 150_000
#: Tokens decoded at once, and steps of a sequence whose scores are held at once.
CHUNK_TOKENS, STRETCH = 60_000, 512

_WORD = r"\w++(?:[.+'’_/–-]++\w++)*+|\n|[^\s\w]"
_TOKEN_PLAIN = re.compile(_WORD)
_TOKEN_MAIL = re.compile(rf"[\w.+'’-]++@[\w-]++(?:\.[\w-]++)+|{_WORD}")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
#: Lines whose tags a worker keeps.
MEMO_LINES = 150_000
_EDGE_SPACE = re.compile(r"[ \t  -   　]+")


def shape(token: str) -> str:
    out, last, n = [], "", 0
    for c in token:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if k == last:
            n += 1
            continue
        if last:
            out.append(last + (str(min(n, 9)) if last == "d" else "+" if n > 1 else "") if last.isalnum() else last)
        last, n = k, 1
    if last:
        out.append(last + (str(min(n, 9)) if last == "d" else "+" if n > 1 else "") if last.isalnum() else last)
    return "".join(out)


def _masked(text: str) -> str:
    """Every digit as 0; a digit counts as such, never its value."""
    return text.encode("utf-8", "surrogatepass").translate(_DIGITS).decode("utf-8", "surrogatepass")


def _part(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % NAME_PARTS


class Names:
    """First and last parts of listed names, as features of the tagger; ``some`` fill training sentences."""

    def __init__(self, first: frozenset[int], last: frozenset[int], some: tuple[str, ...]):
        self.first, self.last, self.some = first, last, some

    @classmethod
    def of(cls, names: list[str]) -> Names:
        parts = [n.lower().split() for n in names]
        return cls(frozenset(_part(p[0]) for p in parts if p), frozenset(_part(p[-1]) for p in parts if len(p) > 1), tuple(sorted(names)[:NAMES_IN_TRAINING]))

    def key(self) -> tuple:
        return tuple(sorted(self.first)), tuple(sorted(self.last)), self.some


def features(token: str, names: Names) -> list[str]:
    low = _masked(token.lower())
    s = shape(token)
    out = ["w:" + low, "s:" + s, "c:" + re.sub(r"[0-9+]", "", s)[:6], "e3:" + low[-3:], "e2:" + low[-2:], "b2:" + low[:2], "1"]
    if "@" in token and len(token) > 3:
        out.append("@")
    if "." in token[1:-1] and not any(c.isdigit() for c in token):
        out.append("dotted")
    digits = sum(c.isdigit() for c in token)
    if digits:
        out.append(f"n:{min(digits, 12)}")
    if low in pii_examples.TRADE_WORDS:
        out.append("trade")
    if names.first and token[0].isalpha():
        part = _part(low)
        if part in names.first:
            out.append("first")
        if part in names.last:
            out.append("last")
    return out


def _pattern(text: str) -> re.Pattern:
    return _TOKEN_MAIL if "@" in text else _TOKEN_PLAIN


def tokenize(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    spans = [m.span() for m in _pattern(text).finditer(text)]
    return [text[a:b] for a, b in spans], spans


def _gold(spans: list[tuple[int, int]], marked: list[tuple[int, int, str]]) -> list[int]:
    out = [0] * len(spans)
    for a, b, kind in marked:
        begun = False
        for k, (x, y) in enumerate(spans):
            if x < b and y > a:
                out[k] = LABELS.index(("I-" if begun else "B-") + kind)
                begun = True
    return out


def _legal() -> np.ndarray:
    """0 where one label may follow another, else very negative."""
    t = np.zeros((_L, _L), dtype=np.float32)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    t[i, j] = -1e4
    return t


class Tagger:
    """Weights, and decoding with them."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray, names: Names):
        self.index, self.weights, self.names = index, weights, names
        self.plain_moves, self.plain_start = moves, start
        self.moves = moves + _legal()
        self.start = start + np.where([label[0] == "I" for label in LABELS], -1e4, 0).astype(np.float32)
        self.memo: dict[str, int] = {}
        self.lines: dict[str, list[tuple[int, int, str]]] = {}
        self.rows = np.zeros((1024, _OFFSETS, _L), dtype=np.float32)

    def _row(self, token: str) -> int:
        k = len(self.memo)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        ids = [self.index[f] for f in features(token, self.names) if f in self.index]
        self.rows[k] = self.weights[ids].sum(axis=0) if ids else 0
        self.memo[token] = k
        return k

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sequence."""
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        get, row = self.memo.get, self._row
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(sequences)
        at = 0
        while at < len(order):
            longest = max(1, len(sequences[order[at]]))
            take = order[at : at + max(1, CHUNK_TOKENS // longest)]
            at += len(take)
            lengths = np.array([len(sequences[k]) for k in take])
            if not lengths[0]:
                continue
            ids = np.full((len(take), longest), -1, dtype=np.int64)
            for r, k in enumerate(take):
                ids[r, : lengths[r]] = [i if (i := get(t)) is not None else row(t) for t in sequences[k]]
            outside = ids < 0
            back = np.zeros((len(take), longest, _L), dtype=np.int8)
            for start in range(0, longest, STRETCH):
                end = min(longest, start + STRETCH)
                emit = np.zeros((len(take), end - start, _L), dtype=np.float32)
                for o in range(-REACH, REACH + 1):
                    low, high = max(start, -o), min(end, longest - o)
                    if low >= high:
                        continue
                    part = self.rows[ids[:, low + o : high + o], o + REACH]
                    part[outside[:, low + o : high + o]] = 0
                    emit[:, low - start : high - start] += part
                if start == 0:
                    best = emit[:, 0] + self.start
                    final = best.copy()
                else:
                    best = best - best.max(axis=1, keepdims=True)  # sums stay small, however long the sequence
                for t in range(max(1, start), end):
                    live = int(np.searchsorted(-lengths, -t, side="left"))  # sequences longer than t
                    # over the labels before in a loop: each step is one pass over plain rows
                    top = best[:live, 0, None] + self.moves[0]
                    came = np.zeros((live, _L), dtype=np.int8)
                    for i in range(1, _L):
                        other = best[:live, i, None] + self.moves[i]
                        better = other > top
                        np.copyto(top, other, where=better)
                        np.putmask(came, better, i)
                    back[:live, t] = came
                    best = top + emit[:live, t - start]
                    final[:live] = best
            last = final.argmax(axis=1)
            paths = np.zeros((len(take), longest), dtype=np.int8)
            rows = np.arange(len(take))
            paths[rows, lengths - 1] = last
            for t in range(longest - 1, 0, -1):
                live = int(np.searchsorted(-lengths, -t, side="left"))
                paths[:live, t - 1] = back[rows[:live], t, paths[:live, t]]
            for r, k in enumerate(take):
                out[k] = paths[r, : lengths[r]]
        return out


def _batch(seqs: list[list[str]], golds: list[list[int]], vocab: dict[str, int], of_token: list[list[int]]) -> tuple:
    """One training batch with all index arrays that its gradient needs."""
    n, T = len(seqs), max(len(s) for s in seqs)
    own = {t: k for k, t in enumerate(dict.fromkeys(t for s in seqs for t in s))}
    ids = np.full((n, T + 2 * REACH), len(own), dtype=np.int64)
    gold, mask = np.zeros((n, T), dtype=np.int64), np.zeros((n, T), dtype=bool)
    for r, (s, g) in enumerate(zip(seqs, golds, strict=True)):
        ids[r, REACH : REACH + len(s)] = [own[t] for t in s]
        gold[r, : len(s)] = g
        mask[r, : len(s)] = True
    pairs = [(k, f) for t, k in own.items() for f in of_token[vocab[t]]]  # every token has the feature "1"
    tok, feat = (np.array(x) for x in zip(*pairs, strict=True))
    tok_first = np.unique(tok, return_index=True)[1]
    order = np.argsort(feat, kind="stable")
    feats, feat_first = np.unique(feat[order], return_index=True)
    gathers = []
    for o in range(_OFFSETS):
        flat = ids[:, o : o + T].ravel()
        by_token = np.argsort(flat, kind="stable")
        which, first = np.unique(flat[by_token], return_index=True)
        gathers.append((by_token, first, which))
    return ids, gold, mask, feat, tok_first, feats, tok[order], feat_first, gathers


def train(names: Names, epochs: int = 14, seed: int = 7, frames: tuple[str, ...] | None = None) -> Tagger:
    """Fit by Adam on the labelled table, or on some of its frames; the same weights for the same names."""
    table = pii_examples.labelled_table(list(names.some), seed=seed, frames=frames)
    seqs, golds = [], []
    for text, marked in table:
        tokens, spans = tokenize(text)
        if tokens:
            seqs.append(tokens)
            golds.append(_gold(spans, marked))
    counts = Counter(f for s in seqs for t in s for f in features(t, names))
    # single words must not be learnt by heart: names and places are unlike elsewhere
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= (6 if f[0] == "w" else 4)))}
    vocab: dict[str, int] = {}
    for s in seqs:
        for t in s:
            vocab.setdefault(t, len(vocab))
    of_token = [[index[f] for f in features(t, names) if f in index] for t in vocab]
    W = np.zeros((len(index), _OFFSETS * _L), dtype=np.float32)
    A, S = np.zeros((_L, _L), dtype=np.float32), np.zeros(_L, dtype=np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (W, A, S)]
    legal = _legal()
    begin = np.where([label[0] == "I" for label in LABELS], -1e4, 0).astype(np.float32)
    rng = np.random.default_rng(seed)
    by_length = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
    batches = [_batch([seqs[k] for k in by_length[i : i + 128]], [golds[k] for k in by_length[i : i + 128]], vocab, of_token) for i in range(0, len(by_length), 128)]
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            ids, gold, mask, tok_feat, tok_first, feats, feat_tok, feat_first, gathers = batches[b]
            n, T = gold.shape
            E = np.zeros((len(tok_first) + 1, _OFFSETS * _L), dtype=np.float32)  # the last row is outside of every sequence
            E[:-1] = np.add.reduceat(W[tok_feat], tok_first, axis=0)
            emit = np.zeros((n, T, _L), dtype=np.float32)
            for o in range(_OFFSETS):
                emit += E[ids[:, o : o + T], o * _L : (o + 1) * _L]
            moves, start = A + legal, S + begin
            alpha = np.zeros((n, T, _L), dtype=np.float32)
            beta = np.zeros((n, T, _L), dtype=np.float32)
            alpha[:, 0] = emit[:, 0] + start
            for t in range(1, T):
                x = alpha[:, t - 1, :, None] + moves
                top = x.max(axis=1, keepdims=True)
                new = top[:, 0] + np.log(np.exp(x - top).sum(axis=1)) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(T - 2, -1, -1):
                x = (beta[:, t + 1] + emit[:, t + 1])[:, None, :] + moves
                top = x.max(axis=2, keepdims=True)
                new = top[..., 0] + np.log(np.exp(x - top).sum(axis=2))
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            top = alpha[:, -1].max(axis=1, keepdims=True)
            z = top[:, 0] + np.log(np.exp(alpha[:, -1] - top).sum(axis=1))
            delta = -np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
            delta[np.arange(n)[:, None], np.arange(T)[None, :], gold] += mask
            flat = delta.reshape(-1, _L)
            gE = np.zeros_like(E)
            for o, (order, first, which) in enumerate(gathers):
                gE[which, o * _L : (o + 1) * _L] = np.add.reduceat(flat[order], first, axis=0)
            gW = np.zeros_like(W)
            gW[feats] = np.add.reduceat(gE[feat_tok], feat_first, axis=0)
            gA = np.zeros_like(A)
            for t in range(1, T):
                x = alpha[:, t - 1, :, None] + moves + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
                gA -= (np.exp(np.minimum(x, 0)) * mask[:, t, None, None]).sum(axis=0)
                np.add.at(gA, (gold[:, t - 1], gold[:, t]), mask[:, t].astype(np.float32))
            gS = delta[:, 0].sum(axis=0)
            step += 1
            rate = 0.06 * (1 - epoch / epochs) + 0.004
            for x, g, (m1, m2) in zip((W, A, S), (gW, gA, gS), state, strict=True):
                g = g / n - 2e-5 * x
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.99
                m2 += 0.01 * g * g
                x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return Tagger(index, W.reshape(len(index), _OFFSETS, _L), A, S, names)


@lru_cache(maxsize=2)
def _trained(key: tuple) -> Tagger:
    first, last, some = key
    return train(Names(frozenset(first), frozenset(last), some))


def trained(names: Names) -> Tagger:
    return _trained(names.key())


# ---------------------------------------------------------------- exact check of form

_EMAIL = re.compile(r"[\w.+'’-]+\s*(?:@|\(at\)|\[at\]|\bat\b|\(@\)|＠)\s*[\w-]+(?:\.[\w-]+)+", re.I)
_NI = re.compile(r"[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d]")
_SSN = re.compile(r"\d{3}[ –-]\d{2}[ –-]\d{4}")
_PASSPORT = re.compile(r"[A-Z]{1,2}\d{7,8}|\d{9}", re.I)
_PHONE = re.compile(r"\+?\(?\d[\d()/. –-]*\d")
_SENTENCE_END = re.compile(r"(?<=[a-zß]{4})\.\s+(?=[A-Z])")
_TITLE = re.compile(r"(?:(?:mrs?|ms|mx|miss|dr|prof|sir|herr|frau)\b\.?\s+)+", re.I)
_NAME_EDGE = " \t,;:.!?()[]<>\"“”„«»–—-*_"


def checked(kind: str, text: str) -> str | None:
    """The datum within a found span, or None if its form is impossible."""
    t = " ".join(_EDGE_SPACE.sub(" ", text.replace("\n", " ")).split())
    if kind == "email":
        m = _EMAIL.search(t)
        return m[0] if m else None
    if kind == "phone":
        m = _PHONE.search(t)
        if not m:
            return None
        t = m[0]
        if t.count("(") > t.count(")"):
            t = t.replace("(", "", 1) if t[0] == "(" else t
        return t if 9 <= sum(c.isdigit() for c in t) <= 15 else None
    if kind == "national_id":
        for p in (_NI, _SSN, _PASSPORT):
            m = p.search(t)
            if m:
                return m[0]
        return None
    if kind == "address":
        t = _SENTENCE_END.split(t, maxsplit=1)[0].strip(" ,.;:")
        return t if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and len(t) >= 8 else None
    t = _TITLE.sub("", t, count=1) if _TITLE.match(t) else t
    t = t.strip(_NAME_EDGE)
    return t if sum(c.isalpha() for c in t) >= 2 and not any(c.isdigit() or c in "@&" for c in t) else None


# ---------------------------------------------------------------------- texts to spans


def segments(text: str) -> list[tuple[int, int]]:
    """[start, end) of the pieces that are tagged on their own: lines, joined after a comma."""
    out = []
    start = None
    at = 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare:
            start = at if start is None else start
        if start is not None and not bare.endswith(","):
            out.append((start, at + len(line)))
            start = None
        at += len(line)
    if start is not None:
        out.append((start, at))
    return out


def find_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """[(start, end, kind)] of every text.

    Lines that are equal but for the values of digits have equal tags, so each such
    line is tagged once and remembered.
    """
    if len(tagger.lines) > MEMO_LINES:
        tagger.lines.clear()
    known = tagger.lines
    todo: list[str] = []
    cut = []
    for text in texts:
        plain = _masked(text)
        parts = [(a, plain[a:b]) for a, b in segments(plain)]
        cut.append(parts)
        for _, s in parts:
            if s not in known:
                known[s] = []
                todo.append(s)
    for k in range(0, len(todo), 20_000):
        seqs, owner = [], []
        for s in todo[k : k + 20_000]:
            clean = s.replace("\r\n", " \n").replace("\r", "\n") if "\r" in s else s
            tokens = _pattern(clean).findall(clean)
            seqs.append(tokens)
            owner.append((s, clean))
        for labels, (s, clean) in zip(tagger.decode(seqs), owner, strict=True):
            if not labels.any():
                continue
            spans = [m.span() for m in _pattern(clean).finditer(clean)]
            found, open_at = known[s], None
            for t, lab in enumerate(labels.tolist()):
                if lab == 0 or lab % 2 == 1:  # O or B closes
                    if open_at is not None:
                        found.append((spans[open_at][0], spans[t - 1][1], KINDS[(labels[open_at] - 1) // 2]))
                        open_at = None
                    if lab:
                        open_at = t
            if open_at is not None:
                found.append((spans[open_at][0], spans[-1][1], KINDS[(labels[open_at] - 1) // 2]))
    return [[(a + x, a + y, kind) for a, s in parts for x, y, kind in known[s]] for parts in cut]


def _names(blocklist: DataFrame | None) -> Names:
    """The listed names as hashed parts, at most NAME_PARTS of each kind, and some of them for training."""
    if blocklist is None:
        return Names.of([])
    listed = blocklist.where("entry_kind = 'literal_name' and trim(entry_text) <> ''").select(F.trim("entry_text").alias("name"))
    words = F.split(F.lower("name"), r"\s+")
    parts = listed.select(F.explode(F.array(F.struct(F.lit("first").alias("side"), F.get(words, F.lit(0)).alias("word")), F.struct(F.lit("last").alias("side"), F.when(F.size(words) > 1, F.get(words, F.size(words) - 1)).alias("word")))).alias("p"))
    rows = parts.where("p.word is not null").select("p.side", (F.crc32("p.word") % NAME_PARTS).alias("part")).distinct().collect()
    some = listed.distinct().orderBy(F.crc32("name"), "name").limit(NAMES_IN_TRAINING).collect()
    return Names(frozenset(r.part for r in rows if r.side == "first"), frozenset(r.part for r in rows if r.side == "last"), tuple(sorted(r.name for r in some)))


_FOUND = "delivery_id bigint, field_name string, pii_kind string, pii_text string"


def _fields(text, markup, to) -> list[tuple[str, str]]:
    out = []
    if text:
        out.append(("body_text", text))
    if markup:
        out.append(("body_html", visible_text(markup)))
    if to is not None:
        out.extend(("to_addrs", a) for a in to if a)
    return out


def personal_data(messages: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """(delivery_id, field_name, pii_kind, pii_text), distinct.

    Mapped over rows without a shuffle but for the final distinct.  Null, empty and
    blank fields and null addresses give nothing; texts of any length are read
    whole; rows repeated under one delivery_id add nothing new.
    """
    shared = messages.sparkSession.sparkContext.broadcast(_model(trained(_names(blocklist))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _worker_tagger(shared)
        for pdf in batches:
            where, texts = [], []
            for delivery_id, text, markup, to in zip(pdf["delivery_id"], pdf["body_text"], pdf["body_html"], pdf["to_addrs"], strict=True):
                for field, t in _fields(text, markup, to):
                    where.append((delivery_id, field))
                    texts.append(t)
            rows = set()
            for (delivery_id, field), t, spans in zip(where, texts, find_spans(texts, tagger), strict=True):
                for a, b, kind in spans:
                    datum = checked(kind, t[a:b])
                    if datum:
                        rows.add((delivery_id, field, kind, datum))
            yield pd.DataFrame(list(rows), columns=["delivery_id", "field_name", "pii_kind", "pii_text"])

    return messages.select("delivery_id", "body_text", "body_html", "to_addrs").mapInPandas(run, _FOUND).distinct()


def _model(t: Tagger) -> tuple:
    """What workers need, ending with a mark of its content."""
    parts = (t.index, t.weights, t.plain_moves, t.plain_start, t.names)
    mark = hashlib.md5(t.weights.tobytes() + t.plain_moves.tobytes() + repr(t.names.key()).encode()).hexdigest()
    return *parts, mark


_TAGGERS: dict[str, Tagger] = {}


def _worker_tagger(shared) -> Tagger:
    """One tagger a worker; another model, told by its content, takes its place."""
    *parts, mark = shared.value
    if mark not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[mark] = Tagger(*parts)
    return _TAGGERS[mark]


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "address": "[ADDRESS]", "person_name": "[NAME]"}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each datum replaced by its typed placeholder."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        raw = text[a:b]
        if a < at or not checked(kind, raw):
            continue
        if kind == "person_name" and (m := _TITLE.match(raw)):
            a += m.end()
        out.append(text[at:a] + PLACEHOLDERS[kind])
        at = b
    return "".join([*out, text[at:]])


def redacted(messages: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """(delivery_id, body_text, body_html_text, to_addrs) with typed placeholders.

    body_html comes out as the text a reader sees.  Nulls stay null.
    """
    shared = messages.sparkSession.sparkContext.broadcast(_model(trained(_names(blocklist))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _worker_tagger(shared)
        for pdf in batches:
            texts: list[str] = []

            def clean(values: list) -> list:
                kept = [v for v in values if v]
                done = iter(redact(t, s) for t, s in zip(kept, find_spans(kept, tagger), strict=True))
                return [next(done) if v else v for v in values]

            body = clean(pdf["body_text"].tolist())
            seen = clean([None if m is None else visible_text(m) for m in pdf["body_html"]])
            flat = [a for to in pdf["to_addrs"] if to is not None for a in to]
            flat = iter(clean(flat))
            to = [None if x is None else [next(flat) for _ in x] for x in pdf["to_addrs"]]
            del texts
            yield pd.DataFrame({"delivery_id": pdf["delivery_id"], "body_text": body, "body_html_text": seen, "to_addrs": to})

    return messages.select("delivery_id", "body_text", "body_html", "to_addrs").mapInPandas(run, "delivery_id bigint, body_text string, body_html_text string, to_addrs array<string>")
