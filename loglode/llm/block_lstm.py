"""A bidirectional LSTM over the blocks of a page, in numpy: training and labelling."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from loglode.llm.common import words
from loglode.llm.html_blocks import Block

PATH_SIZE, WORD_SIZE, HIDDEN = 256, 16, 16
_SIZE = PATH_SIZE + WORD_SIZE + 6
_SLOTS: dict[str, tuple[int, float]] = {}


def _slot(word: str) -> tuple[int, float]:
    if (known := _SLOTS.get(word)) is None:
        h = zlib.crc32(word.encode())
        if len(_SLOTS) > 100_000:
            _SLOTS.clear()
        known = _SLOTS[word] = (h % PATH_SIZE, 1.0 if h >> 16 & 1 else -1.0)
    return known


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row per block: hashed elements of its path, hashed words of its whole text, and a few plain measures."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), _SIZE))
    at, spots, signs = [], [], []
    for i, b in enumerate(flat):
        for w in set(b.path):
            slot, sign = _slot(w)
            at.append(i)
            spots.append(slot)
            signs.append(sign)
    np.add.at(out, (at, spots), signs)
    found = words(pa.array([b.text for b in flat], pa.string()), lower=True)
    slot = (found.hashes % np.uint64(WORD_SIZE)).astype(np.int64) + PATH_SIZE
    np.add.at(out, (found.text_of, slot), np.where(found.hashes >> np.uint64(40) & np.uint64(1), 1.0, -1.0))
    count = np.diff(found.first)
    text = out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE]
    text /= np.maximum(np.sqrt((text**2).sum(axis=1)), 1)[:, None] * 2
    size = np.array([len(b.text) for b in flat])
    out[:, -6] = np.log1p(size) / 5
    out[:, -5] = np.array([b.linked for b in flat]) / np.maximum(size, 1)
    out[:, -4] = np.log1p(count) / 4
    out[:, -3] = [b.text[-1:] in ".!?" for b in flat]
    out[:, -2] = np.concatenate([np.arange(len(p)) / len(p) for p in pages if p] or [np.zeros(0)])
    out[:, -1] = 1
    return out


def start_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for side in "fb":
        out[f"{side}_in"] = rng.normal(0, 0.15, (_SIZE, 4 * HIDDEN))
        out[f"{side}_rec"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        out[f"{side}_bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return out | {"out": rng.normal(0, 0.15, 2 * HIDDEN), "skip": np.zeros(_SIZE), "out_bias": np.zeros(1)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(w: dict, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction over padded pages (time, page, feature); side b reads from the end."""
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    given = x @ w[f"{side}_in"] + w[f"{side}_bias"]
    h = np.zeros((x.shape[1], HIDDEN))
    c = np.zeros_like(h)
    states, trace = np.zeros((*x.shape[:2], HIDDEN)), []
    for t in steps:
        z = given[t] + h @ w[f"{side}_rec"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        fresh = f * c + i * g
        m = mask[t][:, None]
        trace.append((t, h, c, i, f, o, g, fresh, m))
        c = np.where(m, fresh, c)
        h = np.where(m, o * np.tanh(fresh), h)
        states[t] = h
    return states, trace


def _padded(x: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    out, mask = np.zeros((max(counts), len(counts), x.shape[1])), np.zeros((max(counts), len(counts)), bool)
    at = 0
    for k, n in enumerate(counts):
        out[:n, k], mask[:n, k] = x[at : at + n], True
        at += n
    return out, mask


def scores(w: dict[str, np.ndarray], pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
    """Log-odds of every block of every page to be main text; pages of like length go through together."""
    x = features(pages)
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    while order:
        group = [order.pop()]
        longest = len(pages[group[0]])
        while order and (len(group) + 1) * longest <= cells:
            group.append(order.pop())
        counts = [len(pages[k]) for k in group]
        xs, mask = _padded(np.concatenate([x[first[k] : first[k + 1]] for k in group]), counts)
        both = [_pass(w, side, xs, mask)[0] for side in "fb"]
        logits = both[0] @ w["out"][:HIDDEN] + both[1] @ w["out"][HIDDEN:] + xs @ w["skip"] + w["out_bias"]
        for column, k in enumerate(group):
            out[k] = logits[: len(pages[k]), column]
    return out


def train(pages: list[list[Block]], labels: list[np.ndarray], epochs: int = 20, batch: int = 16, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the labeller to pages whose blocks are known, by Adam on the cross entropy, back through time."""
    w, rng = start_weights(seed), np.random.default_rng(seed)
    known = [k for k in range(len(pages)) if len(pages[k])]
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(known), key=lambda k: len(pages[k]) + 8 * rng.random())
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for index in rng.permutation(len(groups)):
            group = groups[index]
            counts = [len(pages[k]) for k in group]
            xs, mask = _padded(features([pages[k] for k in group]), counts)
            ys = np.zeros(mask.shape)
            for column, k in enumerate(group):
                ys[: counts[column], column] = labels[k]
            grads = _gradients(w, xs, ys, mask)
            step += 1
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                slow = rate * (1 - epoch / epochs) + 1e-4
                w[k] -= slow * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _gradients(w: dict, xs: np.ndarray, ys: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    passes = {side: _pass(w, side, xs, mask) for side in "fb"}
    states = np.concatenate([passes["f"][0], passes["b"][0]], axis=2)
    error = np.where(mask, _sigmoid(states @ w["out"] + xs @ w["skip"] + w["out_bias"]) - ys, 0) / mask.sum()
    grads = {"out": np.einsum("tp,tph->h", error, states), "skip": np.einsum("tp,tpf->f", error, xs), "out_bias": np.array([error.sum()])}
    for n, side in enumerate("fb"):
        d_given = np.zeros((*xs.shape[:2], 4 * HIDDEN))
        d_rec = np.zeros_like(w[f"{side}_rec"])
        d_h = np.zeros((xs.shape[1], HIDDEN))
        d_c = np.zeros_like(d_h)
        for t, h, c, i, f, o, g, fresh, m in reversed(passes[side][1]):
            d_h = d_h + error[t][:, None] * w["out"][n * HIDDEN : (n + 1) * HIDDEN]
            tanh = np.tanh(fresh)
            d_fresh = np.where(m, d_c + d_h * o * (1 - tanh**2), 0)
            d_z = np.concatenate([d_fresh * g * i * (1 - i), d_fresh * c * f * (1 - f), np.where(m, d_h * tanh * o * (1 - o), 0), d_fresh * i * (1 - g**2)], axis=1)
            d_given[t] = d_z
            d_rec += h.T @ d_z
            d_c = np.where(m, d_fresh * f, d_c)
            d_h = np.where(m, 0, d_h) + d_z @ w[f"{side}_rec"].T
        grads[f"{side}_in"] = np.einsum("tpf,tpg->fg", xs, d_given)
        grads[f"{side}_rec"] = d_rec
        grads[f"{side}_bias"] = d_given.sum(axis=(0, 1))
    return grads
