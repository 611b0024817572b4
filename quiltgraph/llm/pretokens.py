"""Vectorised pre-tokenisation: code point classes and a transition-function scan, without regex.

Finds the boundaries that the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

gives. Each code point becomes a symbol (its class and what it can see one or two places ahead);
a symbol is a function from states to states, and composing such functions is associative. Texts
are laid end to end and cut in blocks; all blocks are scanned at once from every state, the blocks'
functions are combined by doubling, and a second scan from the known states marks the boundaries.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

# Symbols. L, N: letter, number. P: other. A1, A2: apostrophe with a contraction of 1 or 2 letters
# ahead. WC: white space with white space or the end ahead; WS: a space, WL: other white space, with
# something else ahead. RESET is added for the first code point of a text.
L, N, P, A1, A2, WC, WS, WL = range(8)
RESET = 8
# States: what the last code point left open. CUT: nothing. X: a single space that starts a piece.
# C1, C2: so many letters of a contraction still to come.
S_CUT, S_L, S_N, S_P, S_W, S_X, S_C1, S_C2 = range(8)

WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _machine() -> tuple[bytes, bytes]:
    """next state and whether a piece starts, by state * 16 + symbol, as tables for bytes.translate."""
    step = np.zeros((8, 16), np.uint8)
    cut = np.ones((8, 16), bool)
    start = {L: S_L, N: S_N, P: S_P, A1: S_C1, A2: S_C2, WC: S_W, WS: S_X, WL: S_CUT}
    inside = {
        S_L: {L: S_L}, S_N: {N: S_N}, S_P: {P: S_P, A1: S_P, A2: S_P}, S_W: {WC: S_W},
        S_X: {L: S_L, N: S_N, P: S_P, A1: S_P, A2: S_P},
        S_C1: dict.fromkeys(range(8), S_CUT), S_C2: dict.fromkeys(range(8), S_C1),
    }
    for state in range(8):
        for symbol in range(8):
            step[state, symbol] = start[symbol]
            step[state, symbol + RESET] = start[symbol]
            if symbol in inside.get(state, {}):
                step[state, symbol] = inside[state][symbol]
                cut[state, symbol] = False
    return step.tobytes().ljust(256, b"\0"), cut.tobytes().ljust(256, b"\0")


@functools.cache
def tables() -> tuple[np.ndarray, bytes, bytes]:
    kinds = np.full(sys.maxunicode + 1, P, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kinds[c] = L if k == "L" else N
    kinds[WHITE] = WC
    return kinds, *_machine()


def symbols(points: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The symbol of each code point of texts laid end to end; ``starts``: where non-empty texts begin."""
    n = len(points)
    out = kinds[points]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[-1] = True
    white = out == WC
    ahead = np.empty(n, bool)
    ahead[:-1] = white[1:]
    ahead[last] = True
    at = np.flatnonzero(white & ~ahead)
    out[at] = np.where(points[at] == 32, WS, WL)
    quote = np.flatnonzero(points == 39)
    quote = quote[~last[quote]]
    one = points[quote + 1]
    out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = A1
    quote, one = (x[~last[quote + 1]] for x in (quote, one))
    two = points[quote + 2]
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    out[quote[pair]] = A2
    out[starts] += RESET
    return out


def looked_up(state: np.ndarray, column: np.ndarray, table: bytes) -> np.ndarray:
    at = (state << 4) | column
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


def piece_starts(syms: np.ndarray, step: bytes, cut: bytes, width: int = 128) -> np.ndarray:
    """Where pieces start, by a blocked scan of the symbols' transition functions."""
    n = len(syms)
    rows = -(-n // width)
    grid = np.full(rows * width, L, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # a column of each block side by side
    state = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, 1)
    for column in grid:  # the whole block as a function: state at its start -> state at its end
        state = looked_up(state, column, step)
    ends = state.copy()
    hop = 1
    while hop < rows:  # inclusive scan by doubling: f[i] = f[i] after f[i - hop]
        ends[:, hop:] = np.take_along_axis(ends[:, hop:], ends[:, :-hop].copy(), 0)
        hop *= 2
    now = np.empty(rows, np.uint8)
    now[0] = S_CUT
    now[1:] = ends[S_CUT, :-1]
    marks = np.empty((width, rows), np.uint8)
    for k, column in enumerate(grid):
        marks[k] = looked_up(now, column, cut)
        now = looked_up(now, column, step)
    return np.flatnonzero(marks.T.ravel()[:n])


def pieces(texts: list[str]) -> list[list[str]]:
    """The pieces of each text, in order; their concatenation is the text."""
    kinds, step, cut = tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    if not joined:
        return [[] for _ in texts]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = piece_starts(symbols(points, begins[lengths > 0], kinds), step, cut)
    upto = np.append(at[1:], len(joined)).tolist()
    found = [joined[a:b] for a, b in zip(at.tolist(), upto, strict=True)]
    cuts = np.searchsorted(at, begins).tolist() + [len(found)]
    return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def groups(texts, chars: int = 1 << 19):
    """Consecutive texts in lists of about ``chars`` characters; a longer text is a list of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > chars:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held
