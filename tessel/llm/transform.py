"""Burrows-Wheeler transform of a collection with its common prefixes, built column by column over external files.

Round j inserts one symbol for each document that has j symbols: the one before its suffix of length j, at the place of that
suffix among all suffixes of at most j symbols; and beside it how many symbols that suffix shares with the one above it. The
transform lies in one file and the common prefixes in another; a round reads both once to find the places and prefixes, once
more to merge the new rows, and writes the next two files, all in sequence and block by block. Memory holds a block and a
few numbers for each document. The bytes that occur are numbered from 1 on in their order, and 0 ends a document; byte 255
must not occur with all others, as it never does in UTF-8.

A suffix that begins with symbol c follows, among those, the suffix whose tail is the last row above its own tail's row that
holds c in the transform. Both share c and what their tails share: the least common prefix of the rows between.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Rows of the transform in memory at a time.
BLOCK = 1 << 20
#: No common prefix.
NONE = -1


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair; pairs are not empty, and their ends rise."""
    if not low.size:
        return np.zeros(0, dtype=values.dtype)
    return np.minimum.reduceat(np.append(values, values[-1:]), np.stack((low, high), axis=1).ravel())[::2]


class _Scan:
    """One pass over both files for rows that hold given symbols: how often each symbol stands above its row, and what its
    suffix shares with the one above and the one below it among the suffixes of that symbol."""

    def __init__(self, rows: np.ndarray, symbols: np.ndarray, n_symbols: int) -> None:
        self.rows, self.symbols, self.n_symbols = rows, symbols, n_symbols
        self.ranks = np.empty(rows.size, dtype=np.int64)
        self.above, self.below = np.full(rows.size, NONE, np.int16), np.full(rows.size, NONE, np.int16)
        # over the blocks so far: how often each symbol occurred, the least prefix since, and the row that waits for the next
        self.seen, self.since = np.zeros(n_symbols, np.int64), np.full(n_symbols, 255, np.uint8)
        self.waiting = np.full(n_symbols, -1, np.int64)

    def block(self, low: int, bwt: np.ndarray, lcp: np.ndarray, last: bool) -> None:
        order = np.argsort(bwt, kind="stable")
        counts = np.bincount(bwt, minlength=self.n_symbols)
        begin = np.cumsum(counts) - counts
        a, b = np.searchsorted(self.rows, (low, low + bwt.size))
        at, symbol = self.rows[a:b] - low, self.symbols[a:b]
        # the place of each row among those of its symbol, looked up symbol by symbol
        by, asked = np.argsort(symbol, kind="stable"), np.bincount(symbol, minlength=self.n_symbols)
        k, done = np.empty(at.size, dtype=np.int64), 0
        for s in np.flatnonzero(asked).tolist():
            own = by[done : done + asked[s]]
            k[own] = begin[s] + np.searchsorted(order[begin[s] : begin[s] + counts[s]], at[own])
            done += asked[s]
        self.ranks[a:b] = self.seen[symbol] + k - begin[symbol]
        first = k == begin[symbol]
        start = np.where(first, 0, order[k - 1] + 1)
        shared = _least(lcp, start, at + 1).astype(np.int16)
        self.above[a:b] = np.where(~first, shared, np.where(self.seen[symbol] > 0, np.minimum(shared, self.since[symbol]), NONE))
        more = np.flatnonzero(k + 1 < begin[symbol] + counts[symbol])
        self.below[a + more] = _least(lcp, at[more] + 1, order[k[more] + 1] + 1)
        if last and not low:
            return
        here = np.flatnonzero(counts)
        for s in here[self.waiting[here] >= 0].tolist():
            self.below[self.waiting[s]] = min(self.since[s], lcp[: order[begin[s]] + 1].min())
        self.since = np.minimum(self.since, lcp.min())
        self.waiting[here] = -1
        ends = order[begin[here] + counts[here] - 1]
        self.since[here] = [lcp[e + 1 :].min(initial=255) for e in ends.tolist()]
        own = np.flatnonzero(k + 1 == begin[symbol] + counts[symbol])
        self.waiting[symbol[own]] = a + own
        self.seen += counts


def _merge(old: list, new: list, n: int, rows: np.ndarray, values: list[np.ndarray], changed: np.ndarray, changes: np.ndarray) -> None:
    """Writes the n rows of two files with new ones at the given rows of the result, then changes some rows of the second;
    both kinds of rows rise."""
    for f in (*old, *new):
        f.seek(0)
    before = rows - np.arange(rows.size)  # old rows before each new one
    done = 0
    for low in range(0, max(n, 1), BLOCK):
        size = min(BLOCK, n - low)
        a = np.searchsorted(before, low) if low else 0
        b = np.searchsorted(before, low + size) if low + size < n else rows.size
        keep = np.ones(size + b - a, dtype=bool)
        at = rows[a:b] - low - a
        keep[at] = False
        c, d = np.searchsorted(changed, (done, done + keep.size))
        for k, (file, to) in enumerate(zip(old, new)):
            out = np.empty(keep.size, dtype=np.uint8)
            out[keep] = np.frombuffer(file.read(size), dtype=np.uint8)
            out[at] = values[k][a:b]
            if k:
                out[changed[c:d] - done] = changes[c:d]
            to.write(out)
        done += keep.size


def transform(texts: list[bytes], most: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The transform of the collection and the symbols that each row's suffix shares with the row above, counted up to `most`
    (254 or fewer). Row i < len(texts) is the end of text i, the others follow in order of suffixes."""
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    code = np.zeros(256, dtype=np.uint8)
    code[present] = np.arange(1, present.size + 1)
    flat, n_symbols = code[flat], present.size + 1
    totals = np.zeros(n_symbols, dtype=np.int64)

    def preceding(docs: np.ndarray, length: int) -> np.ndarray:
        """The symbol before the suffix of that length, 0 before the first."""
        at = ends[docs] - length - 1
        return np.where(sizes[docs] > length, flat[np.maximum(at, 0)] if flat.size else 0, 0).astype(np.uint8)

    with tempfile.TemporaryFile(dir=folder) as b1, tempfile.TemporaryFile(dir=folder) as b2, tempfile.TemporaryFile(dir=folder) as p1, tempfile.TemporaryFile(dir=folder) as p2:
        files, others = [b1, p1], [b2, p2]
        docs, rows = np.arange(m), np.arange(m)
        new = preceding(docs, 0)
        b1.write(new)
        p1.write(bytes(m))
        n, length = m, 0
        while True:
            totals += np.bincount(new, minlength=n_symbols)
            alive = new > 0
            docs, rows, last = docs[alive], rows[alive], new[alive]
            if not docs.size:
                break
            length += 1
            scan = _Scan(rows, last, n_symbols)
            for f in files:
                f.seek(0)
            for low in range(0, n, BLOCK):
                size = min(BLOCK, n - low)
                scan.block(low, *(np.frombuffer(f.read(size), np.uint8) for f in files), low + size == n)
            starts = m + np.concatenate(([0, 0], np.cumsum(totals[1:])[:-1]))
            order = np.argsort(last, kind="stable")  # rows rise within each symbol
            docs, rows = docs[order], (starts[last] + scan.ranks)[order]
            above, below = (np.minimum(x[order] + 1, most) for x in (scan.above, scan.below))
            new = preceding(docs, length)
            has = np.flatnonzero(scan.below[order] > NONE)
            _merge(files, others, n, rows, [new, above], rows[has] + 1, below[has])
            n += docs.size
            files, others = others, files
        for f in files:
            f.seek(0)
        bwt, shared = (np.frombuffer(f.read(n), dtype=np.uint8) for f in files)
        return bwt, shared


def repeated_windows(texts: list[bytes], length: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of every string of `length` bytes that also starts earlier: in an earlier text, or earlier in its own.

    Rows that share `length` symbols with the row above lie together; their places are read off the transform. Sorted by
    text, then offset."""
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    bwt, shared = transform(texts, length, folder)
    kind = np.int32 if bwt.size < 2**31 else np.int64
    up = np.empty(bwt.size, dtype=kind)
    up[np.argsort(bwt, kind="stable")] = np.arange(bwt.size, dtype=kind)
    wide = int(sizes.max(initial=0)) + 1
    none = np.iinfo(np.int64).max
    place = np.full(bwt.size, none, dtype=np.int64)
    docs, rows = np.arange(m), np.arange(m, dtype=kind)
    for j in range(1, wide):
        docs, rows = (docs, rows) if (alive := sizes[docs] >= j).all() else (docs[alive], rows[alive])
        rows = up[rows]
        if j >= length:
            place[rows] = docs * wide + (sizes[docs] - j)
    same = shared >= length
    group = np.cumsum(~same) - 1
    least = np.minimum.reduceat(place, np.flatnonzero(~same)) if place.size else place
    found = np.sort(place[(place < none) & (place > least[group])])
    return found // wide, found % wide
