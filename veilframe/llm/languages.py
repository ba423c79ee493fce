"""The language of documents and of stretches in them, by unigram models over the pieces of a public vocabulary."""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veilframe.llm.tokens import PIECES, TOKENIZERS, pieces

#: Labelled documents per label that the models are fitted on, about (the rows with the least hashes).
SAMPLE_PER_LABEL = 400
#: Rounds of re-labelling the sample's sentences, and of expectation-maximisation over segmentations in each.
RELABEL, EM = 2, 3
#: Weight, in pieces, of the probabilities over all languages in each language's own.
SMOOTHING = 30.0
#: A sentence has at least so many words that aren't names, codes or numbers.
SENTENCE_WORDS = 4
#: Lead, in nats, over the document's main language that a sentence in another language needs.
LEAD = 6.0
#: Nats a word by which a label's held-out texts must be likelier under their own model than under any other's.
OWN_LEAD = 0.5
#: Chance that a capitalised word inside a sentence is a name, before its letters are looked at; and the least chance that it isn't for it to count as a word.
NAME_PRIOR, WORD_SURE = 0.5, 0.9

_LINEAR = 40  # letters up to which a word's sums are kept unscaled
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?…])(?<!\b\w\.)(?<!\b\w\.\w\.)\s+|\s+(?=https?://)|(?<=\s)(?=\()|(?<=\))\s")
_MARKUP = re.compile(r"<[^>]{1,80}>|\[[^\]]{1,20}\]|\{[^}]{0,80}\}")
_CODE = re.compile(r"https?://|\S@\S|&\w+;|\d")
_LINK = re.compile(r"https?://\S+|\S+@\S+|&\w+;|\S*\d\S*")
_WORD = re.compile(r"[^\W\d_]+(?:['’`-][^\W\d_]+)*")


def normal_label(label: str | None, codes: dict[str, str]) -> str | None:
    """The two-letter code named by a label in any notation, or null. codes: lower-case code of two or three letters or name -> code."""
    if not label:
        return None
    head = re.split(r"[-_\s]", label.strip().lower())[0]
    return codes.get(head) or codes.get(label.strip().lower())


def segments_of(text: str) -> list[tuple[int, int]]:
    """Offsets of sentence-like stretches: cut at line breaks, after sentence ends (not after initials), and around links and parentheses."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = max(at, m.end())
    if at < len(text):
        out.append((at, len(text)))
    return out


def _words_of_token(token: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(_LINK.sub(" ", token) if _CODE.search(token) else token))


def words_of(segment: str, memo: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """All words of a stretch but those of links, addresses of mail, markup and codes."""
    if "<" in segment or "[" in segment or "{" in segment:
        segment = _MARKUP.sub(" ", segment)
    out: list[str] = []
    for token in segment.split():
        ws = memo.get(token) if memo is not None else None
        if ws is None:
            ws = _words_of_token(token)
            if memo is not None:
                memo[token] = ws
        out += ws
    return out


def is_running(i: int, word: str) -> bool:
    """Whether the word is surely no name by its letter case: in lower case, or the first one of a sentence with the rest in lower case."""
    return word[0].islower() or (i == 0 and word[1:].islower())


@dataclass
class PieceModel:
    """Per-language probabilities of pieces; a text's probability sums over all segmentations. The last column of theta is that of names."""

    languages: list[str]
    vocab: dict[str, int]
    theta: np.ndarray  # pieces x (languages, names)
    prior: np.ndarray
    rows: dict[str, int] = field(default_factory=dict, repr=False)
    scores: list[np.ndarray] = field(default_factory=list, repr=False)
    tokens: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "vocab": self.vocab, "theta": self.theta, "prior": self.prior, "rows": {}, "scores": [], "tokens": {}}

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: ln P(word | language) and ln P(word | name), from a bounded memory or by the forward algorithm."""
        if len(self.rows) > 400_000:
            self.rows.clear()
            self.scores.clear()
        new = list({w for w in words if w not in self.rows})
        if new:
            n = len(self.rows)
            self.rows.update(zip(new, range(n, n + len(new))))
            self.scores.append(word_logs(new, self.vocab, self.theta))
            if len(self.scores) > 1:
                self.scores = [np.concatenate(self.scores)]
        table = self.scores[0] if self.scores else np.zeros((0, self.theta.shape[1]))
        got = table[[self.rows[w] for w in words]]
        return got[:, :-1], got[:, -1]


@dataclass
class Edges:
    """Pieces that fit in words: word, start, end and piece of each, ordered by end."""

    n: int
    length: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


_BASE = np.uint64(0x9E3779B97F4A7C15)
_index_of: list = []  # the last vocabulary and its index


def _index(vocab: dict[str, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pieces by length: sorted hashes and their numbers."""
    if not (_index_of and _index_of[0] is vocab):
        by: dict[int, list[str]] = {}
        for p in vocab:
            by.setdefault(len(p), []).append(p)
        out = {}
        with np.errstate(over="ignore"):
            for k, ps in by.items():
                codes = np.frombuffer("".join(ps).encode("utf-32-le"), dtype=np.uint32).reshape(len(ps), k).astype(np.uint64)
                h = np.zeros(len(ps), dtype=np.uint64)
                for j in range(k):
                    h = h * _BASE + codes[:, j] + np.uint64(1)
                order = np.argsort(h)
                out[k] = (h[order], np.array([vocab[p] for p in ps], dtype=np.int64)[order])
        _index_of[:] = [vocab, out]
    return _index_of[1]


def edges_of(words: list[str], vocab: dict[str, int]) -> Edges:
    """Every piece of the vocabulary at every place of every word; letters that are no piece stand as the unknown one."""
    if not words:
        z = np.zeros(0, dtype=np.int64)
        return Edges(0, z, z, z, z, z)
    marked = ["▁" + w for w in words]
    length = np.array([len(t) for t in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    first = np.cumsum(length) - length
    place = np.arange(len(codes)) - first[word]
    left = length[word] - place
    parts = []
    h = np.zeros(len(codes), dtype=np.uint64)
    index = _index(vocab)
    with np.errstate(over="ignore"):
        at = np.arange(len(codes))
        for k in range(1, max(index, default=1) + 1):
            live = left[at] >= k
            at, h = at[live], h[live]
            if not len(at):
                break
            h = h * _BASE + codes[at + (k - 1)] + np.uint64(1)
            piece = np.full(len(at), len(vocab) if k == 1 else -1, dtype=np.int64)
            if k in index:
                keys, ids = index[k]
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                piece[hit] = ids[i[hit]]
            good = piece >= 0
            parts.append((word[at[good]], place[at[good]], place[at[good]] + k, piece[good]))
    w, s, e, p = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((w, e))
    return Edges(len(words), length, w[order], s[order], e[order], p[order])


def forward(e: Edges, theta: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln of the sum over segmentations for each word and language; with counts (words x languages), the expected counts of pieces."""
    n_lang, top = theta.shape[1], int(e.length.max(initial=0))
    alpha = np.zeros((e.n, top + 1, n_lang))
    alpha[:, 0] = 1.0
    cuts = np.searchsorted(e.end, np.arange(1, top + 2))
    for j in range(1, top + 1):
        s = slice(cuts[j - 1], cuts[j])
        _add_sorted(alpha[:, j], e.word[s], alpha[e.word[s], e.start[s]] * theta[e.piece[s]])
    total = alpha[np.arange(e.n), e.length]
    logp = np.log(np.maximum(total, 1e-300))
    if counts is None:
        return logp, None
    beta = np.zeros_like(alpha)
    beta[np.arange(e.n), e.length] = 1.0
    expected = np.zeros_like(theta)
    scale = counts / np.maximum(total, 1e-300)
    for j in range(top, 0, -1):
        s = slice(cuts[j - 1], cuts[j])
        w, i, p = e.word[s], e.start[s], e.piece[s]
        through = theta[p] * beta[w, j]
        _add_rows(expected, p, alpha[w, i] * through * scale[w])
        np.add.at(beta, (w, i), through)
    return logp, expected


def _add_sorted(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    if len(rows):
        heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        to[rows[heads]] += np.add.reduceat(values, heads, axis=0)


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    if len(rows):
        order = np.argsort(rows, kind="stable")
        _add_sorted(to, rows[order], values[order])


def _long_word(word: str, vocab: dict[str, int], theta: np.ndarray) -> np.ndarray:
    """As forward for one word of any length: only the last places are held, and they are scaled before they vanish."""
    text, longest = "▁" + word, max(_index(vocab), default=1)
    ring = np.zeros((longest + 1, theta.shape[1]))
    ring[0] = 1.0
    log = np.zeros(theta.shape[1])
    for j in range(1, len(text) + 1):
        now = np.zeros(theta.shape[1])
        for k in range(1, min(longest, j) + 1):
            p = vocab.get(text[j - k : j], len(vocab) if k == 1 else None)
            if p is not None:
                now += ring[(j - k) % (longest + 1)] * theta[p]
        ring[j % (longest + 1)] = now
        if j % 8 == 0:
            by = np.maximum(ring.max(axis=0), 1e-300)
            ring /= by
            log += np.log(by)
    return log + np.log(np.maximum(ring[len(text) % (longest + 1)], 1e-300))


def word_logs(words: list[str], vocab: dict[str, int], theta: np.ndarray) -> np.ndarray:
    """ln of the sum over all segmentations of each word, whole words of any length."""
    out = np.empty((len(words), theta.shape[1]))
    size = np.array([len(w) for w in words])
    for lo, hi in ((0, 8), (8, 12), (12, 20), (20, _LINEAR)):
        at = np.flatnonzero((size > lo) & (size <= hi))
        for i in range(0, len(at), 20_000):
            some = at[i : i + 20_000]
            out[some] = forward(edges_of([words[k] for k in some], vocab), theta)[0]
    for k in np.flatnonzero(size > _LINEAR):
        out[k] = _long_word(words[k], vocab, theta)
    return out


def _fit_theta(e: Edges, counts: np.ndarray, pooled: np.ndarray, rounds: int = EM, theta: np.ndarray | None = None) -> np.ndarray:
    """Piece probabilities by expectation-maximisation over segmentations, smoothed toward those of all texts together."""
    theta = np.repeat(pooled, counts.shape[1], axis=1) if theta is None else theta
    for _ in range(rounds):
        _, got = forward(e, theta, counts)
        theta = (got + SMOOTHING * pooled) / (got.sum(axis=0, keepdims=True) + SMOOTHING)
    return theta


def _pooled(e: Edges, counts: np.ndarray, n_pieces: int, rounds: int = EM) -> np.ndarray:
    theta = np.full((n_pieces, 1), 1.0 / n_pieces)
    for _ in range(rounds):
        _, got = forward(e, theta, counts)
        theta = (got + 0.05) / (got + 0.05).sum()
    return theta


def own_labels(own: np.ndarray, held: np.ndarray, label: np.ndarray, words: np.ndarray, size: list[int]) -> list[int]:
    """The labels that name a language of their own, of those given (numbered in any order).

    own: ln P of each text under each label's model; held: that under its own label's model fitted without it (on the other half).
    All labels are judged together: a label's lead is how much likelier, by the word, its held-out texts are under its own model
    than under the best of the others (the median of its texts, since some are labelled wrongly). Of the labels with a lead under OWN_LEAD the one with
    fewest documents in the whole table goes, and the leads are taken anew, until no such label is left. Texts labelled wrongly with another
    language's name, in one or several languages, are explained by those as well as by themselves; two labels for one language have leads about 0 on both sides.
    """
    left = sorted(set(label.tolist()))
    while len(left) > 1:
        lead = {}
        for k in left:
            of = label == k
            best = own[of][:, [x for x in left if x != k]].max(axis=1)
            lead[k] = float(np.median((held[of] - best) / words[of]))
        doubtful = [k for k in left if lead[k] < OWN_LEAD]
        if not doubtful:
            break
        left.remove(min(doubtful, key=lambda k: (size[k], lead[k])))
    return left


def fit(labelled: list[tuple[str, str]], vocab_path: str, sizes: dict[str, int] | None = None) -> PieceModel:
    """Models from (label, text) pairs whose labels may be wrong; sizes: documents of each label in the whole table.

    Which labels name a language of their own is judged for all together (own_labels). Then texts, and at last sentences, move to
    the likeliest language and the models are fitted anew (RELABEL rounds of each). Fitted on the words that are no names by their
    letter case; capitalised ones, weighed by the chance that they are none, come in at the end. The names' own model is that of
    the capitalised words of all languages. Words over 40 letters are scored, but not fitted on.
    """
    docs: list[tuple[str, list[tuple[str, ...]], list[str]]] = []
    for label, text in labelled:
        sents, caps = [], []
        for a, b in segments_of(text):
            ws = [w for w in words_of(text[a:b]) if len(w) <= _LINEAR]
            run = tuple(w.lower() for i, w in enumerate(ws) if is_running(i, w))
            if len(run) >= 3:
                sents.append(run)
                caps += [w.lower() for i, w in enumerate(ws) if not is_running(i, w)]
        if sents:
            docs.append((label, sents, caps))
    if not docs:
        return PieceModel([], {}, np.zeros((1, 1)), np.zeros(0))
    here = Counter(x for x, _, _ in docs)
    size_of = sizes or here
    order = sorted(here, key=lambda x: (-size_of.get(x, here[x]), x))
    words = sorted({w for _, ss, cs in docs for ws in (*ss, cs) for w in ws})
    index = {w: i for i, w in enumerate(words)}
    base = pieces(vocab_path)
    longest = max(map(len, base), default=1)
    used: dict[str, int] = {}
    for t in ("▁" + w for w in words):
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + longest) + 1):
                if (p := t[i:j]) not in used and (j == i + 1 or p in base):
                    used[p] = len(used)
    n_pieces = len(used) + 1
    sents = [np.array([index[w] for w in ws]) for _, ss, _ in docs for ws in ss]
    doc_of = np.repeat(np.arange(len(docs)), [len(ss) for _, ss, _ in docs])
    whole = [np.concatenate(x) for x in _grouped(sents, doc_of, len(docs))]
    running = np.unique(np.concatenate(whole))
    e = edges_of([words[i] for i in running], used)
    to = np.full(len(words), -1)
    to[running] = np.arange(len(running))
    sents, whole = [to[x] for x in sents], [to[x] for x in whole]

    def counted(texts: list[np.ndarray], own: np.ndarray, n: int) -> np.ndarray:
        counts = np.zeros((len(running), n))
        for r, k in zip(texts, own):
            if k >= 0:
                np.add.at(counts[:, k], r, 1)
        return counts

    def summed(logp: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        return np.add.reduceat(logp[np.concatenate(texts)], np.concatenate(([0], np.cumsum([len(r) for r in texts])[:-1])), axis=0)

    label = np.array([order.index(x) for x, _, _ in docs], dtype=np.int64)
    fold = np.zeros(len(docs), dtype=np.int64)
    for k in range(len(order)):
        of = np.flatnonzero(label == k)
        fold[of] = np.arange(len(of)) % 2
    n = len(order)
    pooled = _pooled(e, counted(whole, np.zeros(len(whole), dtype=np.int64), 1), n_pieces)
    halves = [counted(whole, np.where(fold == f, label, -1), n) for f in (0, 1)]
    theta = _fit_theta(e, np.concatenate([halves[0] + halves[1], *halves], axis=1), pooled)
    by_all = summed(forward(e, theta)[0], whole)
    held = by_all[np.arange(len(docs)), n + (1 - fold) * n + label]
    taken = own_labels(by_all[:, :n], held, label, np.array([len(r) for r in whole]), [size_of.get(x, here[x]) for x in order])
    languages = [order[k] for k in taken]
    theta = theta[:, taken]
    logp, _ = forward(e, theta)
    prior = np.zeros(len(languages))
    for texts in [whole] * RELABEL + [sents] * RELABEL:
        own = np.argmax(summed(logp, texts) + prior, axis=1)
        size = np.bincount(own, minlength=len(languages)) + 1e-3
        prior = np.log(size / size.sum())
        counts = counted(texts, own, len(languages))
        theta = _fit_theta(e, counts, pooled)
        logp, _ = forward(e, theta)
    # Names of all languages together, and the capitalised words that are likelier words of their document's language.
    main = np.argmax(summed(logp, whole) + prior, axis=1)
    caps = Counter((index[w], int(main[d])) for d, (_, _, cs) in enumerate(docs) for w in cs)
    if not caps:
        return PieceModel(languages, used, np.concatenate([theta, pooled], axis=1), prior)
    cap_words = sorted({w for w, _ in caps})
    at = {w: i for i, w in enumerate(cap_words)}
    ce = edges_of([words[w] for w in cap_words], used)
    cc = np.zeros((len(cap_words), len(languages)))
    for (w, k), c in caps.items():
        cc[at[w], k] = c
    names = _pooled(ce, cc.sum(axis=1, keepdims=True), n_pieces, 2)
    for _ in range(2):
        lang, _ = forward(ce, theta)
        name, _ = forward(ce, names)
        sure = 1 / (1 + np.exp(np.clip(name - lang, -50, 50)) * NAME_PRIOR / (1 - NAME_PRIOR))
        _, more = forward(ce, theta, cc * sure)
        _, got = forward(e, theta, counts)
        got = got + more
        theta = (got + SMOOTHING * pooled) / (got.sum(axis=0, keepdims=True) + SMOOTHING)
    return PieceModel(languages, used, np.concatenate([theta, names], axis=1), prior)


def _grouped(items: list[np.ndarray], group: np.ndarray, n: int) -> list[list[np.ndarray]]:
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    for x, g in zip(items, group):
        out[g].append(x)
    return out


Segment = tuple[int, int, str, float, int]


def classify(texts: list[str], model: PieceModel) -> list[list[Segment]]:
    """For each text start, end, language, confidence and number of running words of each stretch in one language.

    All words of a text are scored; a capitalised word inside a sentence as a name or a word of the language, weighed by its chance to be each. A sentence is in the
    main language of the document unless another leads by LEAD nats and it has SENTENCE_WORDS words. Neighbouring stretches of one language are merged.
    """
    out: list[list[Segment]] = [[] for _ in texts]
    if not model.languages:
        return out
    if len(model.tokens) > 400_000:
        model.tokens.clear()
    words: list[str] = []
    running: list[bool] = []
    doc, lo, hi, starts = [], [], [], []
    for d, text in enumerate(texts):
        for a, b in segments_of(text) if text else ():
            ws = words_of(text[a:b], model.tokens)
            if ws:
                doc.append(d)
                lo.append(a)
                hi.append(b)
                starts.append(len(words))
                words += ws
                running += [w[0].islower() for w in ws]
                running[starts[-1]] = is_running(0, ws[0])
    if not doc:
        return out
    lang, name = model.score([w.lower() for w in words])
    run = np.array(running)
    cap = np.flatnonzero(~run)
    as_word = lang[cap] + math.log(1 - NAME_PRIOR)
    as_name = name[cap, None] + math.log(NAME_PRIOR)
    lang[cap] = np.logaddexp(as_word, as_name)
    sure = np.where(run[:, None], 1.0, 0.0).repeat(lang.shape[1], axis=1)
    chance = np.exp(as_word - lang[cap])
    sure[cap] = chance >= WORD_SURE
    some = run.astype(float)
    some[cap] = chance.max(axis=1) > 0.5
    scores = np.add.reduceat(lang, starts, axis=0)
    n_words = np.add.reduceat(sure, starts, axis=0)
    n_all = np.diff([*starts, len(words)])
    d = np.array(doc)
    rows = np.arange(len(d))
    best = np.argmax(scores, axis=1)
    liked = np.argmax(scores + model.prior, axis=1)
    votes = np.zeros((len(texts), len(model.languages)))
    n_liked = n_words[rows, liked]
    whole = n_liked >= SENTENCE_WORDS
    np.add.at(votes, (d[whole], liked[whole]), n_liked[whole])
    total = np.zeros_like(votes)
    np.add.at(total, d, scores)
    main = np.where(votes.any(axis=1), votes.argmax(axis=1), (total + model.prior).argmax(axis=1))[d]
    other = (best != main) & (n_words[rows, best] >= SENTENCE_WORDS) & (scores[rows, best] - scores[rows, main] >= LEAD)
    pick = np.where(other, best, main)
    p = np.exp((scores - scores.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n_all, 1))[:, None])
    conf = p[rows, pick] / p.sum(axis=1)
    n = n_words[rows, pick].astype(int)
    n[n < SENTENCE_WORDS] = 0
    spoken = (np.add.reduceat(some, starts) > 0) | votes.any(axis=1)[d]  # a stretch of names only, in a text of nothing else, is in no language
    for i in range(len(d)):
        if not spoken[i]:
            continue
        to = out[doc[i]]
        code, c, k = model.languages[pick[i]], float(conf[i]), int(n[i])
        if to and to[-1][2] == code:
            q = to[-1]
            x, y = max(q[4], 1), max(k, 1)
            to[-1] = (q[0], hi[i], code, (q[3] * x + c * y) / (x + y), q[4] + k)
        else:
            to.append((lo[i], hi[i], code, c, k))
    return out


def label_codes(lang_codes: DataFrame) -> dict[str, str]:
    """Codes of two and three letters and names, in lower case, of the fixed table of languages."""
    out: dict[str, str] = {}
    for r in lang_codes.select("lang_code", "lang_code3", "lang_name").filter("lang_code is not null").collect():
        out |= {x.lower(): r["lang_code"].lower() for x in r if x}
    return out


def fit_on(documents: DataFrame, codes: dict[str, str], per_label: int = SAMPLE_PER_LABEL, folder: str = TOKENIZERS) -> PieceModel:
    """Fit the models on a bounded sample of the labelled documents: about per_label rows of each label, whole texts."""
    raw = documents.filter("lang is not null and text is not null").groupBy("lang").count().filter("count > 0")
    # Only labels that name a language are looked at; they are few, whatever the table.
    names = sorted({*codes})
    head = F.element_at(F.split(F.lower(F.trim("lang")), r"[-_\s]"), 1)
    known = raw.filter(head.isin(names)).groupBy(head.alias("h")).agg(F.sum("count").alias("n")).collect()
    size: Counter[str] = Counter()
    for r in known:
        size[codes[r["h"]]] += r["n"]
    rate = {h: min(1.0, per_label / size[codes[h]]) for h in (r["h"] for r in known)}
    if not rate:
        return PieceModel([], {}, np.zeros((1, 1)), np.zeros(0))
    cond = F.lit(False)
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000))
    for h, x in rate.items():
        cond = cond | ((head == h) & (u < int(x * 1_000_000)))
    rows = documents.filter("lang is not null and text is not null").filter(cond).select("lang", "text", "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([(normal_label(r["lang"], codes), r["text"]) for r in rows], os.path.join(folder, PIECES), dict(size))


def document_languages(documents: DataFrame, lang_codes: DataFrame, per_label: int = SAMPLE_PER_LABEL, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, label, lang_code, confidence, n_words, status, segments) of every document.

    label is the language that documents.lang names, or null. segments holds start, end (code points, end excluded),
    language, confidence and running words of each stretch; lang_code is the language of most words. status is
    'right', 'wrong', 'missing' (no label or none that names a language), 'mixed' (whole sentences in several languages) or
    'none' (null or blank text, or no word: no language). All texts are read whole; only the models are fitted on a sample.
    """
    codes = label_codes(lang_codes)
    model = documents.sparkSession.sparkContext.broadcast((fit_on(documents, codes, per_label, folder), codes))
    schema = (
        "doc_id long, label string, lang_code string, confidence double, n_words long, status string, "
        "segments array<struct<start_pos:int,end_pos:int,lang_code:string,confidence:double,n_words:int>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known = model.value
        for pdf in batches:
            rows = []
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                for d, segs, lang in zip(part["doc_id"].tolist(), classify(part["text"].tolist(), m), part["lang"].tolist()):
                    label = normal_label(lang, known)
                    if not segs:
                        rows.append((d, label, None, None, 0, "none", []))
                        continue
                    by: dict[str, float] = {}
                    for s in segs:
                        by[s[2]] = by.get(s[2], 0) + (s[4] or 0.001)
                    lead = max(by, key=by.get)
                    conf = sum(s[3] * max(s[4], 1) for s in segs if s[2] == lead) / sum(max(s[4], 1) for s in segs if s[2] == lead)
                    status = "mixed" if sum(v >= 1 for v in by.values()) > 1 else "missing" if label is None else "right" if label == lead else "wrong"
                    rows.append((d, label, lead, conf, int(sum(s[4] for s in segs)), status, segs))
            out = pd.DataFrame(rows, columns=["doc_id", "label", "lang_code", "confidence", "n_words", "status", "segments"])
            out["segments"] = out["segments"].map(lambda x: [dict(zip(("start_pos", "end_pos", "lang_code", "confidence", "n_words"), s)) for s in x])
            yield out

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInPandas(run, schema)


def found_languages(languages: DataFrame) -> DataFrame:
    """(doc_id, lang_code) of documents whose label is missing or wrong or whose text is mixed: one row per language of a whole sentence.

    A document without a whole sentence gives its most likely language.
    """
    odd = languages.filter(F.col("status").isin("missing", "wrong", "mixed"))
    whole = F.array_distinct(F.transform(F.filter("segments", lambda s: s["n_words"] > 0), lambda s: s["lang_code"]))
    return odd.select("doc_id", F.explode(F.when(F.size(whole) > 0, whole).otherwise(F.array("lang_code"))).alias("lang_code")).distinct()
