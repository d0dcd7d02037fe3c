"""Plain forms of what the operators compute, one document after another."""

import hashlib
import random
import re

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key long, words string, own_lang int, kept string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def documents(seed=1, n=60):
    """Random documents with shared passages, copies, near copies and every odd case, as (doc_id, text)."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Straße", "日本", "naïve", "the", "The", "x|y", "#"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    short = passage[3:17]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        for piece in (passage, short, passage[:12], passage[10:]):
            if rng.random() < 0.25:
                at = rng.randint(0, len(words))
                words[at:at] = piece
        rows.append((i * 3, "".join(w + rng.choice([" ", " ", " ", "\n", "\t "]) for w in words)))
    for i in range(12):
        words = WORD.findall(rows[rng.randrange(n)][1])
        if i % 3 and words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    long = " ".join(rng.choice(vocabulary) for _ in range(3000)) + " " + " ".join(passage * 3)
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one two"), (2004, "One two"), (2005, long), (2006, "same " * 40), (2007, "a" * 5000)]
    rows += [(None, rows[3][1]), (None, "one two"), rows[5], rows[5], (2008, "x\x0by\x0cz q r")]
    return rows


def frame(spark, rows):
    """The documents with columns of other names, some of which the operators use inside."""
    full = [(i, t, ["en", "de", None][k % 3], ["s1", None][k % 2], None if t is None else len(t), "x", 5, "y", 6, "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3, "n_chars")


def substring(rows, size=13):
    """Per row: words, which of them are removed."""
    last = 1 << 63
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), ws in zip(rows, words, strict=True):
        for k in range(len(ws) - size + 1):
            key = tuple(ws[k : k + size])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = [False] * len(ws)
        for k in range(len(ws) - size + 1):
            if first[tuple(ws[k : k + size])] < (last if i is None else i):
                gone[k : k + size] = [True] * size
        out.append((ws, gone))
    return out


def cut(text, gone):
    """The text without the words that are gone and the blanks after them."""
    spots = [m.span() for m in WORD.finditer(text)]
    out = []
    for k, (a, b) in enumerate(spots):
        if not gone[k]:
            runs_on = k + 1 < len(spots) and not gone[k + 1]
            follows = k + 1 < len(spots)
            out.append(text[a : spots[k + 1][0] if follows else b] if runs_on or follows else text[a:b])
    return "".join(out)


def shingles(text, n=5):
    ws = WORD.findall(lower(text))
    if not ws:
        return set()
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)}


def near_groups(rows, percent=75):
    """doc_id to component, over rows with an id."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    top[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def least_errors(pattern, text):
    """Edit distance of the pattern to the closest part of the text."""
    row = np.arange(len(pattern) + 1)
    best = row[-1]
    steps = np.arange(len(pattern) + 1)
    letters = np.array(list(pattern))
    for c in text:
        fresh = np.empty_like(row)
        fresh[0] = 0
        fresh[1:] = np.minimum(row[:-1] + (letters != c), row[1:] + 1)
        row = np.minimum.accumulate(fresh - steps) + steps
        best = min(best, row[-1])
    return int(best)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
