"""SuperMinHash signatures of many sets at once."""

from __future__ import annotations

import numpy as np

from loglode.llm.common import mix

SLOTS = 128
_LEVEL = np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64(0xFFFFFFFF)


def signatures(elements: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of `slots` ranks per set; set i holds elements[first[i]:first[i + 1]], empty sets stay at the maximum.

    Every element draws, step by step, one more place of a random permutation and a fraction; the slot at that place
    gets the smallest step + fraction of all elements. A set stops after the step at which all its slots are filled
    with ranks no later step can undercut. All elements take one step together, which gives the same minima as going
    element by element.
    """
    count = len(first) - 1
    out = np.full((count, slots), np.iinfo(np.uint64).max, np.uint64)
    sets = np.flatnonzero(np.diff(first))
    owner = np.repeat(np.arange(count), np.diff(first))
    places: np.ndarray | None = None
    for step in range(slots):
        if not len(sets):
            break
        draw = mix(elements + np.array([step + 1], np.uint64) * _LEVEL)
        pick = step + ((draw & _LOW) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        if places is None:
            slot, picks = pick, pick
        else:
            rows = np.arange(len(elements))
            slot = places[rows, pick]
            places[rows, pick] = places[rows, step]
            places[rows, step] = slot
        rank = np.uint64(step) << np.uint64(32) | draw >> np.uint64(32)
        np.minimum.at(out.reshape(-1), owner * slots + slot, rank)
        full = out[sets].max(axis=1) < np.uint64(step + 1) << np.uint64(32)
        if full.any() or places is None:
            going = np.zeros(count, bool)
            going[sets[~full]] = True
            keep = going[owner]
            sets, owner, elements = sets[~full], owner[keep], elements[keep]
            if places is None:
                if len(elements) > 1 << 17 and len(sets) > 1:  # the permutations of few elements at a time
                    return _halves(out, elements, owner, sets, picks[keep], slots)
                places = _start(picks[keep], slots)
            else:
                places = places[keep]
    return out


def _start(picks: np.ndarray, slots: int) -> np.ndarray:
    """The permutations after the first step: the first place and the picked one exchanged."""
    places = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64), (len(picks), slots)).copy()
    rows = np.arange(len(picks))
    places[rows, picks] = 0
    places[:, 0] = picks
    return places


def _halves(out, elements, owner, sets, picks, slots) -> np.ndarray:
    """Finish groups of sets of some 100,000 elements each, from the first step on."""
    counts = np.bincount(owner, minlength=len(out))[sets]
    ends = np.cumsum(counts)
    at = 0
    while at < len(sets):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + (1 << 17), "right")))
        part = elements[base : ends[upto - 1]]
        if upto - at == 1 and len(part) > 1 << 17:
            first = np.array([0, len(part)])
            out[sets[at]] = _one(part, slots)
        else:
            first = np.concatenate([[0], np.cumsum(counts[at:upto])])
            out[sets[at:upto]] = signatures(part, first, slots)
        at = upto
    return out


def _one(elements: np.ndarray, slots: int) -> np.ndarray:
    """A single large set: few elements fill all slots, the rest can only matter at the steps those need."""
    out = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 1 << 16):
        part = elements[at : at + (1 << 16)]
        out = np.minimum(out, signatures(part, np.array([0, len(part)]), slots)[0])
    return out
