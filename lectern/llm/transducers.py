"""A byte-level BPE tokenizer compiled to finite-state transducers that count tokens.

Two machines in a row count the tokens of a text.

``WORD CUTS`` is a deterministic transducer over classes of characters. Its transitions say whether a pre-token starts at the
character just read or at the one before. A text is dealt to chunks; each chunk yields the map from every start state to
its end state, the maps of all chunks are composed by a parallel prefix scan, and with the start states known the
cuts are written in a second pass. All chunks of many texts step together.

``BpeCounter`` reads the bytes of a pre-token. The tokens of every prefix are BPE's own for that prefix, and BPE's tokens
of a longer prefix differ from those of a shorter one only in a bounded tail. So the state keeps, for each suffix
of what was read that may still become part of a token, the place in the vocabulary's trie, the token that ends before
the suffix, and how many tokens that was ago; each transition carries by how much the number of tokens changes, and
the sum along a pre-token is its number of tokens. States and transitions are compiled when first met and
kept for the life of the worker; all distinct pre-tokens of a batch step together through the table.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

# States of the word cutter: after a cut or at the start; in letters, numbers or others; one or several white spaces of
# which the last is a space or another one; after an apostrophe that starts a pre-token, and after 'r, 'v and 'l.
FRESH, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, APOSTROPHE, AP_R, AP_V, AP_L = range(12)
N_STATES = 12
SPACE, WHITE, NUMBER, OTHER, QUOTE, LETTER, ENDS_1, C_R, C_E, C_V, C_L, RESET = range(12)
N_CLASSES = 12
CUT_HERE, CUT_BEFORE = 1, 2

#: The white space of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cuts) by state and class: contractions, then runs of letters, numbers or others with one space before, then white space of which the last goes to what follows."""
    letters = (LETTER, ENDS_1, C_R, C_E, C_V, C_L)

    def fresh(c: int) -> int:
        return LETTERS if c in letters else {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: APOSTROPHE, SPACE: ONE_SPACE, WHITE: ONE_WHITE, RESET: FRESH}[c]

    step, cuts = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            white = c in (SPACE, WHITE)
            now, cut = fresh(c), CUT_HERE
            if s in (LETTERS, AP_R, AP_V, AP_L) and c in letters:
                now, cut = LETTERS, 0
            elif s == NUMBERS and c == NUMBER:
                cut = 0
            elif s in (OTHERS, APOSTROPHE) and c in (OTHER, QUOTE):
                now, cut = OTHERS, 0
            elif s in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE) and white:
                now, cut = (MORE_SPACE if c == SPACE else MORE_WHITE), 0
            elif s in (ONE_SPACE, MORE_SPACE) and c != RESET:
                now, cut = (OTHERS if c == QUOTE else fresh(c)), 0
            if s in (MORE_SPACE, MORE_WHITE) and not white and c != RESET:
                cut |= CUT_BEFORE
            if s == APOSTROPHE and c in (ENDS_1, C_R, C_V, C_L):
                now, cut = {ENDS_1: FRESH, C_R: AP_R, C_V: AP_V, C_L: AP_L}[c], 0
            if (s, c) in ((AP_R, C_E), (AP_V, C_E), (AP_L, C_L)):
                now, cut = FRESH, 0
            elif s in (AP_R, AP_V, AP_L):
                cut |= CUT_BEFORE
            step[s, c], cuts[s, c] = now, cut
    return step, cuts


STEP, CUTS = _word_machine()


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[[ord(c) for c in WHITE_SPACE]] = WHITE
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for c, kind in (("s", ENDS_1), ("t", ENDS_1), ("m", ENDS_1), ("d", ENDS_1), ("r", C_R), ("e", C_E), ("v", C_V), ("l", C_L)):
        out[ord(c)] = kind
    return out


def word_cuts(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """True where a pre-token starts, for one array of classes that starts fresh; RESET characters are pre-tokens each."""
    n = len(classes)
    lanes = -(-(n + 1) // chunk)
    grid = np.full(lanes * chunk, RESET, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    flat_step, flat_cuts = STEP.ravel(), CUTS.ravel()
    # every chunk's map from start state to end state
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for t in range(chunk):
        maps = flat_step[maps * np.uint8(N_CLASSES) + grid[t]]
        if t % 16 == 15 and (maps == maps[:1]).all():  # every start state has come to the same state everywhere
            state = maps[0]
            for u in range(t + 1, chunk):
                state = flat_step[state * np.uint8(N_CLASSES) + grid[u]]
            maps = np.repeat(state[None], N_STATES, axis=0)
            break
    # parallel prefix scan: after k rounds each map covers 2**k chunks
    gap, lane = 1, np.arange(lanes)
    while gap < lanes:
        maps = np.concatenate([maps[:, :gap], maps[maps[:, :-gap], lane[gap:]]], axis=1)
        gap *= 2
    state = np.concatenate([[np.uint8(FRESH)], maps[FRESH, :-1]])
    marks = np.empty((chunk, lanes), np.uint8)
    for t in range(chunk):
        at = state * np.uint8(N_CLASSES) + grid[t]
        marks[t], state = flat_cuts[at], flat_step[at]
    marks = marks.T.reshape(-1)
    starts = (marks[:n] & CUT_HERE).astype(bool)
    starts |= (marks[1 : n + 1] & CUT_BEFORE).astype(bool)
    return starts


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where printable, else one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeCounter:
    """The transducer of one vocabulary, compiled as far as it has been used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letter = spec["model"], byte_alphabet()
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = tokens[a + b]
            self.rank[tokens[a], tokens[b]] = r
            self.made.setdefault(made, (tokens[a], tokens[b], r))
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends: dict[int, int] = {}  # node -> token
        parents = set()
        size = 1
        for text, token in tokens.items():
            node = 0
            for c in text:
                parents.add(node)
                node, known = self.trie.get(node << 8 | letter[c]), node
                if node is None:
                    node = self.trie[known << 8 | letter[c]] = size
                    size += 1
            self.ends[node] = token
        self.parents = parents
        self.spines: dict[tuple[int, int], list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self._state(((0, -1, 0),))
        self.size = 1 << 16
        self.used = 0
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.zeros(self.size, np.int64)  # next state << 8 | change + 128

    def _state(self, content: tuple) -> int:
        at = self.states.get(content)
        if at is None:
            at = self.states[content] = len(self.content)
            self.content.append(content)
        return at

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at a token's left (0) or right (1) edge while it is being merged, each with the rank that ends it."""
        found = self.spines.get((token, side))
        if found is None:
            found, ends = [(token, float("inf"))], token
            while ends in self.made:
                found.append((self.made[ends][side], self.made[ends][2]))
                ends = self.made[ends][side]
            found = self.spines[token, side] = found[::-1]
        return found

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay apart: no merge over the border comes before those within."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right, i, j, known = self._spine(a, 1), self._spine(b, 0), 0, 0, True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                merge = self.rank.get((x, y))
                if merge is not None and merge < until_x and merge <= until_y:
                    known = False
                    break
                if until_x == until_y == float("inf"):
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The transition from state by byte, as it stands in values."""
        grown, last, change = [], -1, 0
        for node, before, count in self.content[state]:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            grown.append((child, before, count))
            if last < 0 and (token := self.ends.get(child)) is not None and (before < 0 or self.stays(before, token)):
                last, change = token, count + 1
        content = tuple((child, before, count - change) for child, before, count in grown if child in self.parents)
        return self._state((*content, (0, last, 0))) << 8 | change + 128

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the free place where it belongs."""
        mask = self.size - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & mask
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
            at[open_] = (at[open_] + 1) & mask
        return at

    def _insert(self, keys: list[int], values: list[int]) -> None:
        if (self.used + len(keys)) * 3 > self.size * 2:
            old = self.keys >= 0
            keys, values = [*self.keys[old].tolist(), *keys], [*self.values[old].tolist(), *values]
            while len(keys) * 3 > self.size:
                self.size *= 2
            self.keys, self.values, self.used = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64), 0
        mask = self.size - 1
        first = (((np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & mask).tolist()
        for key, value, at in zip(keys, values, first, strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = key, value
        self.used += len(keys)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start : start + length]."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        longest = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(longest), side="left") if longest else []
        for t in range(longest):
            n = live[t]
            keys = state[:n] << 8 | data[starts[:n] + t]
            at = self._slots(keys)
            missing = np.unique(keys[self.keys[at] < 0])
            if len(missing):
                self._insert(new := missing.tolist(), [self._compile(k >> 8, k & 255) for k in new])
                at = self._slots(keys)
            value = self.values[at]
            state[:n] = value >> 8
            total[:n] += (value & 255) - 128
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@functools.cache
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)
