"""Simple-8b: unsigned integers packed into 64-bit words.

The top four bits of a word are a selector: how many values follow and in how many bits each. The last selector is an
escape: the next word is one raw 64-bit value, for values of more than 60 bits. Values are cut into blocks of BLOCK
values that are packed by themselves; the offsets of their words let any block be decoded alone, or all at once.
"""

from __future__ import annotations

import numpy as np

#: Values in a word and bits of each, by selector; the last selector is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
WIDEST = 60
ESCAPE = 15
BLOCK = 256


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    if not len(values) or values.max() < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    high = (values >> np.uint64(32)).astype(np.float64)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high)[1] + 32, low).astype(np.uint8)


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64), and for each block the number of words before it (uint32).

    A word takes the selector of most values that fit, or that reach the block's end; missing values are zeros.
    One value of 31 to 60 bits has no selector of its own and is escaped as well.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    # A row for each block, with zeros behind it, so that what reaches the block's end fits.
    blocks, row = -(-n // BLOCK), BLOCK + int(COUNTS[0])
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    held = np.zeros((blocks, row), np.uint64)
    held[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    widest = np.zeros((blocks, row), np.uint8)
    widest[:, :BLOCK] = _bits(padded).reshape(blocks, BLOCK)
    # For each position the widest of the next values, of as many as each selector takes in turn, up to where no place is left
    # that would take more values by it (those that reach their block's end by a wider selector already would not).
    selector, taken = np.full((blocks, BLOCK), ESCAPE, np.uint8), 1
    last = n - (blocks - 1) * BLOCK
    for s in range(ESCAPE - 1, -1, -1):
        before, more = taken, int(COUNTS[s]) - taken
        widest, taken = np.maximum(widest[:, :-more], widest[:, more:]), int(COUNTS[s])
        fits = widest[:, :BLOCK] <= WIDTHS[s]
        selector[fits] = s
        if s < ESCAPE - 1 and not (fits[:-1, : max(0, BLOCK - before)].any() or fits[-1, : max(0, last - before)].any()):
            break
    # All blocks take their next word at once.
    held, selector = held.ravel(), selector.ravel()
    which = np.arange(blocks)
    at, limit = np.zeros(blocks, np.int64), np.minimum(BLOCK, n - which * BLOCK)
    of_block, of_at, of_selector = [], [], []
    while len(which):
        s = selector[which * BLOCK + at]
        of_block.append(which)
        of_at.append(at)
        of_selector.append(s)
        at = at + COUNTS[s]
        on = at < limit
        at, limit, which = at[on], limit[on], which[on]
    block, first, sel = np.concatenate(of_block), np.concatenate(of_at), np.concatenate(of_selector)
    order = np.argsort(block, kind="stable")
    block, sel, first = block[order], sel[order], (block * row + first)[order]
    size = 1 + (sel == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(WIDEST)
    for s in range(2, ESCAPE):
        own = np.flatnonzero(sel == s)
        if len(own):
            start, word = first[own], words[place[own]]
            for k in range(COUNTS[s]):
                word |= held[start + k] << np.uint64(k * WIDTHS[s])
            words[place[own]] = word
    escaped = np.flatnonzero(sel == ESCAPE)
    words[place[escaped] + 1] = held[first[escaped]]
    offsets = place[np.searchsorted(block, np.arange(blocks))]
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values, each selector's words unpacked at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(WIDEST)).astype(np.int64)
    # A raw word after an escape is no head; escapes in a row are told apart by walking the runs of possible heads.
    head = np.ones(len(words), bool)
    maybe = np.flatnonzero(sel == ESCAPE)
    skip = -1
    for k in maybe.tolist():
        if k != skip and k + 1 < len(words):
            head[k + 1] = False
            skip = k + 1
    heads = np.flatnonzero(head)
    sel = sel[heads]
    block = np.searchsorted(offsets.astype(np.int64), heads, "right") - 1
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    start_of_block = np.searchsorted(block, np.arange(len(offsets)))
    first = before - before[start_of_block][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in range(2, ESCAPE):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        word, start, end = words[heads[own]], first[own], limit[own]
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            on = start + k < end
            out[start[on] + k] = (word[on] >> np.uint64(k * WIDTHS[s])) & mask
    own = np.flatnonzero(sel == ESCAPE)
    out[first[own]] = words[heads[own] + 1]
    return out
