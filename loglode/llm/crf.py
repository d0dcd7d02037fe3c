"""A linear-chain conditional random field in numpy: features of words, fitting, forward-backward over whole texts.

Nothing here knows Spark. `language_id` draws the sample, fits the field once and carries it to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex

#: A word: a letter, then letters and marks. Digits and signs belong to no word.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BUCKETS = 1 << 14
#: Steps one segment of a text takes in a row; segments of all texts run side by side.
SEGMENT = 32
STEPS = 60
RATE = 0.3
DECAY = 1e-5
#: Words whose scores a task keeps; beyond, it forgets them all and starts again.
KNOWN_WORDS = 200_000

_GRAM, _PREFIX, _SUFFIX = 1, 2, 3
_ONE = np.uint64(0x100000001B3)


@dataclass
class Field:
    """Weights per feature and language, of the change from one language to the next, and of the first word."""

    langs: list[str]
    lexicon: dict[str, np.ndarray]  # word -> 1 for each language among whose frequent words it is
    weights: np.ndarray  # (BUCKETS + languages + 1, languages)
    change: np.ndarray  # (languages, languages)
    start: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": None}


def features(words: list[str], lexicon: dict[str, np.ndarray], n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values and the word of each, for all words end to end.

    N-grams of one to three letters within ^word$ share a value of one, affixes of two to four letters another one;
    then a feature for each language in whose lexicon the word is, and a constant.
    """
    marked = [f"^{w}$" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    last = (first + sizes)[owner]
    grams = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in (1, 2, 3):
            upto = max(len(codes) - n + 1, 0)
            h[:upto] = h[:upto] * _ONE + codes[n - 1 :][:upto] + np.uint64(1)
            at = np.flatnonzero(np.arange(upto) + n <= last[:upto])
            grams.append((owner[at], _bucket(h[at], _GRAM * 8 + n)))
        affixes = []
        for kind, step in ((_PREFIX, 1), (_SUFFIX, -1)):
            h = np.zeros(len(words), np.uint64)
            at = first + 1 if step > 0 else first + sizes - 2
            for n in range(1, 5):
                has = sizes - 2 >= n
                h[has] = h[has] * _ONE + codes[at[has] + (n - 1) * step] + np.uint64(1)
                if n > 1:
                    affixes.append((np.flatnonzero(has), _bucket(h[has], kind * 8 + n)))
    parts, values = [], []
    for group in (grams, affixes):
        who = np.concatenate([g[0] for g in group])
        count = np.bincount(who, minlength=len(words))
        parts.append((who, np.concatenate([g[1] for g in group])))
        values.append(1.0 / count[who])
    hits = [(i, np.flatnonzero(lexicon[w])) for i, w in enumerate(words) if w in lexicon]
    parts.append((np.repeat([i for i, _ in hits], [len(x) for _, x in hits]).astype(np.int64), BUCKETS + np.concatenate([x for _, x in hits]) if hits else np.zeros(0, np.int64)))
    values.append(np.ones(len(parts[-1][0])))
    parts.append((np.arange(len(words)), np.full(len(words), BUCKETS + n_langs)))
    values.append(np.ones(len(words)))
    return np.concatenate([p[1] for p in parts]), np.concatenate(values), np.concatenate([p[0] for p in parts])


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).astype(np.int64) % BUCKETS


def emissions(words: list[str], model: Field) -> np.ndarray:
    """Score of each language for each word."""
    number, value, who = features(words, model.lexicon, len(model.langs))
    out = np.empty((len(words), len(model.langs)))
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(who, value * model.weights[number, k], len(words))
    return out


def look_up(words: list[str], model: Field) -> np.ndarray:
    """Row of each word in model.scores; words not met yet are scored first, each once."""
    fresh = list({w for w in words if w not in model.known})
    if fresh and len(model.known) + len(fresh) > KNOWN_WORDS:
        model.known.clear()
        model.scores = None
        fresh = list(set(words))
    if fresh:
        base = len(model.known)
        model.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        new = emissions(fresh, model)
        model.scores = new if model.scores is None else np.concatenate([model.scores, new])
    known = model.known
    return np.array([known[w] for w in words], np.int64)


def forward_backward(scores: np.ndarray, first: np.ndarray, change: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each language at each word of several texts, every text a chain of its own; and the forward vectors.

    A text is cut into segments. The steps of a segment multiply to one matrix, the matrices of a text carry its forward
    and backward vectors from segment to segment, and then all segments fill in their own words at once.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    emit = np.exp(scores - scores.max(1, keepdims=True))
    move, begin = np.exp(change - change.max()), np.exp(start - start.max())
    sizes = np.diff(first)
    per_text = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = first[:-1][text] + nth * SEGMENT
    length = np.minimum(SEGMENT, first[1:][text] - at)
    order = np.argsort(-length, kind="stable")
    text, nth, at, length = text[order], nth[order], at[order], length[order]
    active = [int(np.searchsorted(-length, -j, "left")) for j in range(SEGMENT)]  # segments with more than j words
    opening = np.flatnonzero(nth == 0)

    product = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
    for j, a in enumerate(active):
        if not a:
            break
        step = product[:a].reshape(-1, k) @ move
        step = step.reshape(a, k, k)
        if j == 0:
            step[opening] = begin
        step *= emit[at[:a] + j][:, None, :]
        product[:a] = _scaled(step, j)

    ahead = np.full((len(at), k), 1.0 / k)  # what comes in from the left of a segment
    behind = np.ones((len(at), k))  # and from its right
    by_nth = np.argsort(nth, kind="stable")
    edges = np.searchsorted(nth[by_nth], np.arange(nth.max() + 2))
    of_text = np.full((len(sizes)), -1, np.int64)
    rounds = [by_nth[edges[i] : edges[i + 1]] for i in range(nth.max() + 1)]
    for i, now in enumerate(rounds):
        if i:
            left = of_text[text[now]]
            v = np.einsum("nk,nkj->nj", ahead[left], product[left])
            ahead[now] = v / v.sum(1, keepdims=True)
        of_text[text[now]] = now
    for now in reversed(rounds):
        right = of_text[text[now]]
        more = right != now
        v = np.einsum("nij,nj->ni", product[right[more]], behind[right[more]])
        behind[now[more]] = v / v.max(1, keepdims=True)
        of_text[text[now]] = now

    alpha = np.empty((n, k))
    v = ahead
    for j, a in enumerate(active):
        if not a:
            break
        step = v[:a] @ move
        if j == 0:
            step[opening] = begin
        step *= emit[at[:a] + j]
        v = _scaled(step, j)
        alpha[at[:a] + j] = v
    p = np.empty((n, k))
    v = behind
    for j in range(SEGMENT - 1, -1, -1):
        a = active[j]
        if a:
            spot = at[:a] + j
            p[spot] = alpha[spot] * v[:a]
            v[:a] = _scaled((v[:a] * emit[spot]) @ move.T, j)
    p /= (p @ np.ones(k))[:, None]
    return p, alpha


def _scaled(step: np.ndarray, j: int) -> np.ndarray:
    """Every fourth step, each entry's numbers brought back to a sum of one."""
    if j % 4 != 3:
        return step
    flat = step.reshape(len(step), -1)
    return (flat / (flat @ np.ones(flat.shape[1]))[:, None]).reshape(step.shape)


def fit(sample: list[tuple[str, list[str]]], lexicon_words: int, seed: int = 1) -> Field:
    """A field fitted to (language, words of a text) by gradient steps on the likelihood.

    Since a text has one label for all its words, changes of language are taught by chains spliced from texts of two
    languages: every text stands once alone and once with the half of another text behind its own.
    """
    langs = sorted({lang for lang, words in sample if words})
    number_of = {lang: i for i, lang in enumerate(langs)}
    k = len(langs)
    texts = [(number_of[lang], words) for lang, words in sorted(sample) if words]
    lexicon = _lexicon(texts, k, lexicon_words)
    vocabulary = sorted({w for _, words in texts for w in words})
    row = {w: i for i, w in enumerate(vocabulary)}
    number, value, who = features(vocabulary, lexicon, k) if vocabulary else (np.zeros(0, np.int64),) * 3
    rng = np.random.default_rng(seed)
    chains = [([row[w] for w in words], [lang] * len(words)) for lang, words in texts]
    for i, j in zip(range(len(texts)), rng.permutation(len(texts)).tolist(), strict=True):
        (a, left), (b, right) = texts[i], texts[j]
        left, right = left[: (len(left) + 1) // 2], right[len(right) // 2 :]
        chains.append(([row[w] for w in [*left, *right]], [a] * len(left) + [b] * len(right)))
    model = Field(langs, lexicon, np.zeros((BUCKETS + k + 1, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    words = np.concatenate([c[0] for c in chains]).astype(np.int64)
    labels = np.concatenate([c[1] for c in chains]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(c[0]) for c in chains])]).astype(np.int64)
    truth = np.eye(k)[labels]
    inner = np.setdiff1d(np.arange(len(words) - 1), first[1:-1] - 1)  # words with a next one in their chain
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[inner], labels[inner + 1]), 1)
    params = [model.weights, model.change, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        by_word = np.stack([np.bincount(who, value * model.weights[number, c], len(vocabulary)) for c in range(k)], 1)
        scores = by_word[words]
        p, forward = forward_backward(scores, first, model.change, model.start)
        wrong = np.stack([np.bincount(words, (p - truth)[:, c], len(vocabulary)) for c in range(k)], 1)
        grad = np.stack([np.bincount(number, value * wrong[who, c], len(model.weights)) for c in range(k)], 1)
        # alpha x move x emit x beta of two neighbours, summed; emit x beta is what p has beyond alpha x move
        move, left = np.exp(model.change), forward[inner]
        joint = move * (left.T @ (p[inner + 1] / (left @ move)))
        grads = [grad / len(words) + DECAY * model.weights, (joint - seen) / len(words) + DECAY * model.change, (p[first[:-1]] - truth[first[:-1]]).mean(0) / 10]
        for q, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _lexicon(texts: list[tuple[int, list[str]]], k: int, size: int) -> dict[str, np.ndarray]:
    """The most frequent words of each language's sample, ties by the word."""
    out: dict[str, np.ndarray] = {}
    for lang in range(k):
        counts: dict[str, int] = {}
        for at, words in texts:
            if at == lang:
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        for w in sorted(counts, key=lambda w: (-counts[w], w))[:size]:
            out.setdefault(w, np.zeros(k, bool))[lang] = True
    return out
