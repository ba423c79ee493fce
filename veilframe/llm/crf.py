"""A skip-chain conditional random field: linear chains with extra links between like tokens, decoded by loopy message passing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class CRF:
    """Weights of hashed features by label, of label pairs, of first labels, and of equal types over a skip link."""

    labels: list[str]
    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    skip: float

    @property
    def types(self) -> np.ndarray:
        """The entity type of each label as a number; 0 for O."""
        names = sorted({x[2:] for x in self.labels if x != "O"})
        return np.array([0 if x == "O" else 1 + names.index(x[2:]) for x in self.labels])


def marginals(unary: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node marginals (documents x tokens x labels), summed pair marginals and ln Z of padded linear chains; probabilities scaled at each token."""
    n, t, k = unary.shape
    top = unary.max(axis=2)
    e = np.exp(unary - top[:, :, None])
    go = np.exp(trans)
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((n, t))
    alpha[:, 0] = e[:, 0] * np.exp(start)
    for i in range(t):
        if i:
            alpha[:, i] = (alpha[:, i - 1] @ go) * e[:, i]
        c = np.maximum(alpha[:, i].sum(axis=1), 1e-300)
        live = mask[:, i]
        scale[live, i] = c[live]
        alpha[:, i] /= c[:, None]
        if i and not live.all():
            alpha[~live, i] = alpha[~live, i - 1]
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        after = e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]
        live = mask[:, i + 1]
        pairs += alpha[live, i].T @ after[live]
        beta[:, i] = np.where(live[:, None], after @ go.T, beta[:, i + 1])
    node = alpha * beta * mask[:, :, None]
    return node, pairs * go, (np.log(scale) + np.where(mask, top, 0)).sum(axis=1)


def viterbi(unary: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    n, t, k = unary.shape
    best = unary[:, 0] + start
    back = np.zeros((n, t, k), dtype=np.int8)
    for i in range(1, t):
        s = best[:, :, None] + trans
        back[:, i] = s.argmax(axis=1)
        new = s.max(axis=1) + unary[:, i]
        best = np.where(mask[:, i, None], new, best)
    out = np.zeros((n, t), dtype=np.int64)
    last = mask.sum(axis=1) - 1
    cur = best.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        here = i <= last
        out[here, i] = cur[here]
        move = here & (i > 0)
        cur[move] = back[move, i, cur[move]]
    return out


def _unary(feats: list[np.ndarray], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded label scores; feats: tokens x features, -1 for none."""
    t = max(len(f) for f in feats)
    u = np.zeros((len(feats), t, emit.shape[1]))
    mask = np.zeros((len(feats), t), dtype=bool)
    for d, f in enumerate(feats):
        u[d, : len(f)] = emit[f].sum(axis=1)
        mask[d, : len(f)] = True
    return u, mask


#: Documents, and tokens with padding, that are looked at together.
BATCH, BATCH_TOKENS = 64, 25_600


def by_size(items: list, sizes: list[int]) -> list[list]:
    """Batches of items given in order of size; an item of any size is in one batch, alone if it is large."""
    out: list[list] = []
    for x, n in zip(items, sizes):
        if not out or len(out[-1]) >= BATCH or (len(out[-1]) + 1) * n > BATCH_TOKENS:
            out.append([])
        out[-1].append(x)
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], n_features: int, skips: list[list[tuple[int, int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-6) -> CRF:
    """Piecewise maximum likelihood: the chain by adaptive gradient steps, the skip weight from how much more often types agree over skip links than those of their ends by chance.

    Feature 0 is the absent one. Documents are taken in the order given, so the fit is repeatable.
    """
    k = len(labels)
    emit, trans, start = np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k)
    for a, x in enumerate(labels):  # an inside label follows its own type only
        for b, y in enumerate(labels):
            if y[0] == "I" and x[2:] != y[2:]:
                trans[a, b] = -1e4
        if x[0] == "I":
            start[a] = -1e4
    ge, gt, gs = np.full_like(emit, 1e-3), np.full_like(trans, 1e-3), np.full_like(start, 1e-3)
    free = trans > -1e3
    order = np.argsort([len(y) for _, y in docs], kind="stable")
    groups = by_size(order.tolist(), [len(docs[i][1]) for i in order])
    rng = np.random.default_rng(7)
    mean, steps = [np.zeros_like(emit), np.zeros_like(trans), np.zeros_like(start)], 0
    at = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            part = [docs[i] for i in groups[g]]
            u, mask = _unary([f for f, _ in part], emit)
            node, pairs, _ = marginals(u, mask, trans, start)
            gold = np.zeros_like(node)
            seen = np.zeros((k, k))
            for d, (_, y) in enumerate(part):
                gold[d, np.arange(len(y)), y] = 1.0
                np.add.at(seen, (y[:-1], y[1:]), 1.0)
            diff = (gold - node)[mask]
            flat = np.concatenate([f for f, _ in part])
            rows, inv = np.unique(flat, return_inverse=True)
            inv = inv.reshape(flat.shape)
            grad = np.zeros((len(rows), k))
            order_ = np.argsort(inv.ravel(), kind="stable")
            r = inv.ravel()[order_]
            heads = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            grad[r[heads]] = np.add.reduceat(diff[order_ // flat.shape[1]], heads, axis=0)
            grad -= l2 * emit[rows]
            grad[rows == 0] = 0
            ge[rows] += grad**2
            emit[rows] += rate * grad / np.sqrt(ge[rows])
            dt = np.where(free, seen - pairs, 0)
            gt += dt**2
            trans += rate * dt / np.sqrt(gt)
            ds = np.where(start > -1e3, (gold - node)[:, 0].sum(axis=0), 0)
            gs += ds**2
            start += rate * ds / np.sqrt(gs)
            at += 1
            if epoch >= epochs // 2 and at % 8 == 0:  # the weights are averaged over the later steps, so they depend less on single records
                steps += 1
                for m, w in zip(mean, (emit, trans, start)):
                    m += (w - m) / steps
    if steps:
        emit, trans, start = mean
    model = CRF(labels, emit, trans, start, 0.0)
    ty = model.types
    same = [ty[docs[d][1][i]] == ty[docs[d][1][j]] for d, links in enumerate(skips) for i, j in links]
    if same:
        ends = [ty[docs[d][1][k]] for d, links in enumerate(skips) for link in links for k in link]
        base = np.bincount(ends) + 0.5
        by_chance = min(((base / base.sum()) ** 2).sum(), 1 - 1e-6)  # also where all ends are of one type
        agree = (sum(same) + 1) / (len(same) + 2)
        model.skip = float(np.clip(np.log(agree / (1 - agree)) - np.log(by_chance / (1 - by_chance)), 0.0, 4.0))
    return model


def decode(model: CRF, feats: list[np.ndarray], skips: list[list[tuple[int, int]]], rounds: int = 3) -> list[np.ndarray]:
    """The label of each token. Chains without skip links are decoded exactly; the others by `rounds` of messages over
    the skip links between exact passes over the chain, then once more along the chain with the last messages."""
    if not feats:
        return []
    u, mask = _unary(feats, model.emit)
    out = viterbi(u, mask, model.trans, model.start)
    linked = [d for d, s in enumerate(skips) if s]
    if linked and model.skip > 0:
        same = np.exp(model.skip * (model.types[:, None] == model.types[None, :]))
        lu, lm = u[linked], mask[linked]
        edges = [(n, i, j) for n, d in enumerate(linked) for i, j in skips[d]]
        a = np.array([(n, i, j) for n, i, j in edges] + [(n, j, i) for n, i, j in edges])  # message from [1] to [2]
        msg = np.zeros((len(a), u.shape[2]))
        opposite = np.concatenate((np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))))
        extra = np.zeros_like(lu)
        for _ in range(rounds):
            node, _, _ = marginals(lu + extra, lm, model.trans, model.start)
            belief = node[a[:, 0], a[:, 1]] * np.exp(-msg[opposite])
            belief /= np.maximum(belief.sum(axis=1, keepdims=True), 1e-300)
            msg = np.log(belief @ same)
            msg -= msg.max(axis=1, keepdims=True)
            extra = np.zeros_like(lu)
            np.add.at(extra, (a[:, 0], a[:, 2]), msg)
        out[linked] = viterbi(lu + extra, lm, model.trans, model.start)
    return [out[d, : len(f)] for d, f in enumerate(feats)]
