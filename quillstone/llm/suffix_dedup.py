"""Exact removal of every byte covered by a `length`-byte string that also starts earlier in the corpus.

1. Anchors. In each window of `length` bytes the k-byte string with the least hash is its anchor, so equal
   windows have equal anchors at equal offsets. Only anchors (some 3 % of the positions) are shuffled,
   each with the hash of its context: all bytes that a window around it can hold.
2. Of anchors with equal context hashes the earliest stays and the others are repeats. A task settles its own copies
   before the shuffle, so a hot string sends at most one row for each batch of texts, and compares their bytes. Copies of
   rows of other tasks are claims: neighbouring ones are merged into one span, and the span's SHA-256 must be that of the
   bytes at the place it claims to repeat, which the other text's task computes. If a claim fails (two contexts of one
   hash), everything is done again with the contexts' bytes in place of their hashes.
3. Where an anchor has several contexts, their bytes are fetched and suffix-sorted from the anchor onwards
   and backwards: prefix polynomial hashes and binary search give the common extension of two suffixes in
   logarithmic time, a merge sort orders them, and adjacent extensions are verified byte by byte. Suffixes
   with a common extension are runs in that order, so a window is the pair of its run to the
   left and its run to the right, and the earliest row of a pair is the one that stays.
4. The contexts of an anchor that has over `most` are split by the windows' place into pieces and dealt by all bytes that
   the windows of a piece share (some 83 of 100). Of a piece that still has over `together` rows, the windows themselves
   are dealt and compared in sorted order. So no group has to fit in a task.

Texts travel compressed. Defined results: null and empty texts have no bytes; a null doc_id counts as the
smallest; rows with the same id and text are one document, rows with the same id and different texts are
documents ordered by the text's hash; an empty table gives no rows; further columns, whatever their names, are ignored
by the report and kept by the cleaning form.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LENGTH, K, MOST, SORTED = 100, 32, 20_000, 20_000
#: Bytes hashed together (arrays that fit a cache), bytes of a tile of a long text, rows settled together, bytes of data sorted together.
BLOCK, TILE, ROWS, DATA = 1 << 18, 1 << 22, 500_000, 64 << 20
#: Bits of a context's hash; pieces that the windows of a hot anchor are dealt in.
CONTEXT_BITS, PIECES = 64, 4
MASK = (1 << 64) - 1
BASE, MIX = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FIRST = -(1 << 63)
FULL, NEED, HOT, CLAIM, TEXT = 1, 2, 3, 4, 5
DOC, TIE, BYTES = "__quillstone_doc", "__quillstone_tie", "__quillstone_bytes"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all k-byte strings, from those of strings of powers of two."""
    power, width, now, out, have = BASE, 1, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX), None, 0
    now ^= now >> np.uint64(29)
    rest = k
    while True:
        if rest & 1:
            if out is None:
                out, have = now, width
            else:
                n = min(len(out), len(now) - have)
                out = out[:n] * np.uint64(power) + now[have : have + n]
                have += width
        rest >>= 1
        if not rest:
            break
        now = now[:-width] * np.uint64(power) + now[width:]
        power, width = power * power & MASK, 2 * width
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(MIX)
    out ^= out >> np.uint64(30)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def find_anchors(segments: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(segment, position, low, high, key) of all anchors: windows position - high to position - low have it."""
    starts = np.cumsum([0] + [len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    h = gram_hashes(data, k)
    low = np.uint64((1 << 24) - 1)
    at = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    np.add.at(valid, starts[:-1], 1)
    np.add.at(valid, starts[1:] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid)[: len(at)])
    at = (at[windows] & low).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.concatenate([begin[1:], [len(at)]]) - 1
    where = at[begin]
    segment = np.searchsorted(starts, where, "right") - 1
    return segment, where - starts[segment], where - windows[end], where - windows[begin], h[where].view(np.int64)


def _tiles(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for s in range(0, max(1, len(data) - length + 1), TILE):
        yield s, data[s : s + TILE + length - 1]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _places(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, tie: np.ndarray, code: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Sorted, one row for each place: an anchor on both sides of a tile's border has the windows of both tiles."""
    order = np.lexsort((code, tie, doc, ctx, key))
    key, ctx, doc, tie, code, *more = (x[order] for x in (key, ctx, doc, tie, code, *more))
    first = np.flatnonzero(_runs(key, ctx, doc, tie, code >> 14))
    if len(first) < len(code):
        high, low = np.maximum.reduceat(code >> 7 & 127, first), np.minimum.reduceat(code & 127, first)
        key, ctx, doc, tie, code, *more = (x[first] for x in (key, ctx, doc, tie, code, *more))
        code = code >> 14 << 14 | high << 7 | low
    return [key, ctx, doc, tie, code, *more]


def _winners(first: np.ndarray) -> np.ndarray:
    """For each row the last one before it that is flagged."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _spans(text: np.ndarray, other: np.ndarray, pos: np.ndarray, other_pos: np.ndarray, size: np.ndarray, length: int, margin: int) -> tuple[np.ndarray, ...]:
    """Contexts that repeat another text's, merged where they touch: (rows in order, span of each, and of each span text, other, first, last, shift)."""
    shift = pos - other_pos
    order = np.lexsort((pos, shift, other, text))
    text, other, pos, shift, size = (x[order] for x in (text, other, pos, shift, size))
    first, last = np.maximum(0, pos - margin), np.minimum(size, pos + length)
    new = _runs(text, other, shift)
    new[1:] |= first[1:] > last[:-1]
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(pos)]])[: len(head)] - 1
    return order, np.cumsum(new) - 1, text[head], other[head], first[head], last[tail], shift[head]


def _record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _apart(doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys for rows that only pass through a shuffle: dealt by document and place."""
    return (doc ^ tie) * 0x5851F42D4C957F2D + at


ANCHORS = "key ctx doc tie code last kind"


def _anchors(length: int, k: int, bits: int, exact: bool) -> Callable:
    import xxhash

    margin = length - k
    keep = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple] = []  # document, tie and text of what is held or found
        held: list[tuple] = []
        found: list[np.ndarray] = []
        contexts: dict[bytes, int] = {}

        def hashed():
            segment, at, low, high, key = find_anchors([part for _, _, part in held], length, k)
            pos = at + np.array([offset for _, offset, _ in held])[segment]
            row = np.array([i for i, _, _ in held])[segment]
            texts, size = [t for _, _, t in ids], np.array([len(t) for _, _, t in ids])[row]
            left, right = np.minimum(pos, margin), np.minimum(size - pos, length)
            spots = zip(row.tolist(), (pos - left).tolist(), (pos + right).tolist(), (left * 256 + right).tolist(), strict=True)
            if exact:
                ctx = np.fromiter((contexts.setdefault(c.to_bytes(2) + texts[r][a:b], len(contexts)) for r, a, b, c in spots), np.int64, len(pos))
            else:
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(texts[r][a:b], c) & keep for r, a, b, c in spots), np.uint64, len(pos)).view(np.int64)
            found.append(np.stack([key, ctx, row, pos << 14 | high << 7 | low]))
            held.clear()

        def settled():
            key, ctx, row, code = np.concatenate(found, 1)
            doc, tie = (np.array([x[i] for x in ids], np.int64)[row] for i in (0, 1))
            key, ctx, doc, tie, code, row = _places(key, ctx, doc, tie, code, row)
            first = _runs(key, ctx)
            again, winner = np.flatnonzero(~first), _winners(first)[~first]
            pos, texts = code >> 14, [t for _, _, t in ids]
            size = np.array([len(t) for t in texts])[row]
            order, span, text, other, begin, end, shift = _spans(row[again], row[winner], pos[again], pos[winner], size[again], length, margin)
            same = np.fromiter((texts[t][a:b] == texts[o][a - d : b - d] for t, o, a, b, d in zip(text.tolist(), other.tolist(), begin.tolist(), end.tolist(), shift.tolist(), strict=True)), bool, len(text))
            # Contexts of one hash that differ go on unsettled.
            first[again[order[~same[span]]]] = True
            some = np.array([x[:2] for x in ids], np.int64)[text[same]].reshape(-1, 2)
            d, t, a, b = some[:, 0], some[:, 1], begin[same], end[same]
            names = dict(zip(contexts.values(), contexts, strict=True))
            ctx_type = pa.binary() if exact else pa.int64()
            yield _record(ANCHORS, _apart(d, t, a), pa.nulls(len(d), ctx_type), d, t, a, b, np.full(len(d), FULL, np.int8))
            left = np.flatnonzero(first)
            for s in range(0, len(left), 50_000):
                x = left[s : s + 50_000]
                c = pa.array([names[i] for i in ctx[x].tolist()], ctx_type) if exact else pa.array(ctx[x])
                yield _record(ANCHORS, key[x], c, doc[x], tie[x], code[x], np.zeros(len(x), np.int64), np.zeros(len(x), np.int8))
            found.clear()
            contexts.clear()

        size = 0
        for b in batches:
            for doc, tie, text in zip(*(b.column(c).to_pylist() for c in ("doc", "tie", "text")), strict=True):
                if text is None or len(text) < length:
                    continue
                ids.append((doc, tie, text))
                for offset, part in _tiles(text, length):
                    held.append((len(ids) - 1, offset, part))
                    size += len(part)
                    if size >= BLOCK:
                        hashed()
                        size = 0
                        if sum(x.shape[1] for x in found) >= ROWS:
                            yield from settled()
                            ids[:-1] = []
        if held:
            hashed()
        if found:
            yield from settled()

    return run


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, bool]]:
    """Many rows with all rows of their keys, False; or rows of one key that has over `rows`, True. Batches come sorted by key."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    large = None
    for b in batches:
        for s in range(0, b.num_rows, max(1, rows)):
            part = b.slice(s, max(1, rows))
            held.append(part)
            n, size = n + part.num_rows, size + part.nbytes
            if n < rows and size < DATA:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if large is not None:  # what is left of the large group
                rest = int(np.searchsorted(key, large, "right"))
                if rest:
                    yield t.slice(0, rest), True
                t, key, whole = t.slice(rest), key[rest:], max(0, whole - rest)
                large = large if not len(key) else None
            if whole:
                yield t.slice(0, whole), False
                t = t.slice(whole)
            if t.num_rows >= rows:
                large = t.column("key")[0].as_py()
                yield t, True
                t = t.slice(0, 0)
            held = t.to_batches()
            n, size = t.num_rows, t.nbytes
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        rest = int(np.searchsorted(t.column("key").to_numpy(), large, "right")) if large is not None else 0
        if rest:
            yield t.slice(0, rest), True
        if rest < n:
            yield t.slice(rest), False


SETTLED = "doc tie kind key code last other_doc other_tie other"


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _settle(most: int, exact: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in _groups(batches, 200_000):
            key, doc, tie, code, last, kind = (rows.column(c).to_numpy() for c in ("key", "doc", "tie", "code", "last", "kind"))
            known = kind == FULL
            if known.any():
                none = np.zeros(int(known.sum()), np.int64)
                yield _record(SETTLED, doc[known], tie[known], kind[known], none, code[known], last[known], none, none, none)
                rows = rows.filter(pa.array(~known))
                key, doc, tie, code = (x[~known] for x in (key, doc, tie, code))
            if not len(key):
                continue
            ctx = _codes(rows.column("ctx")) if exact else rows.column("ctx").to_numpy()
            key, ctx, doc, tie, code = _places(key, ctx, doc, tie, code)
            first, group = _runs(key, ctx), np.cumsum(_runs(key)) - 1
            n, winner = np.bincount(group, first)[group], _winners(first)
            kind = np.where(first, np.where((n > most) | large, HOT, NEED), CLAIM).astype(np.int8)
            out = np.flatnonzero(~first | (n > 1) | large)
            if len(out):
                w = winner[out]
                yield _record(SETTLED, doc[out], tie[out], kind[out], key[out], code[out], np.zeros(len(out), np.int64), doc[w], tie[w], code[w] >> 14)

    return run


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tie"), pa.array([pack(t or b"") for t in b.column("text").to_pylist()], pa.binary())], names=["doc", "tie", "packed"])


CONTEXTS = "key doc tie code last data kind other_doc other_tie other"
CONTEXT_TYPES = (pa.int64(),) * 5 + (pa.binary(), pa.int8()) + (pa.int64(),) * 3


def _served(doc: int, tie: int, salt: int) -> int:
    """The key under which claims meet the text they claim to repeat."""
    import xxhash

    return xxhash.xxh3_64_intdigest(struct.pack("<qqq", doc, tie, salt)) - (1 << 63)


def _contexts(length: int, k: int, salts: dict[tuple[int, int], int]) -> Callable:
    """What has to meet: bytes of all windows of each needed anchor (in pieces for hot ones), digests of claimed spans, and the texts they name."""
    margin = length - k
    edges = [round(i * (margin + 1) / PIECES) for i in range(PIECES + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        hot: list[tuple] = []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return _record(CONTEXTS, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), CONTEXT_TYPES, strict=True)))

        def pieces():
            """Of equal pieces the first goes on, whatever the task; the others are settled by their bytes."""
            hot.sort()
            before, out = None, []
            for key, data, high, low, doc, tie, pos in hot:
                if (key, data, high, low) == before:
                    first = pos - high
                    out.append((_hashed(doc, tie, first), doc, tie, first, pos - low + length, None, FULL, 0, 0, 0))
                else:
                    out.append((key, doc, tie, pos << 14 | high << 7 | low, 0, data, NEED, 0, 0, 0))
                before = (key, data, high, low)
            hot.clear()
            return out

        for b in batches:
            packed, doc_ids, ties = (b.column(c).to_pylist() for c in ("packed", "doc", "tie"))
            texts, out = [unpack(x) for x in packed], []
            for doc, tie, text, data, n, needs in zip(doc_ids, ties, texts, packed, b.column("claimants").to_pylist(), b.column("needs").to_pylist(), strict=True):
                for salt in range(salts.get((doc, tie), 1) if n else 0):
                    out.append((_served(doc, tie, salt), doc, tie, 0, 0, data, TEXT, 0, 0, 0))
                for x in needs or ():
                    pos, high, low = x["code"] >> 14, x["code"] >> 7 & 127, x["code"] & 127
                    if x["kind"] == NEED:
                        out.append((x["key"], doc, tie, x["code"], 0, text[pos - high : pos - low + length], NEED, 0, 0, 0))
                        continue
                    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        h, l = min(high, hi - 1), max(low, lo)
                        if l <= h:
                            # Every window of the piece has these bytes.
                            key = xxhash.xxh3_64_intdigest(text[pos - lo : pos + length - (hi - 1)], i) - (1 << 63)
                            hot.append((key, text[pos - h : pos - l + length], h, l, doc, tie, pos))
                if len(hot) >= ROWS // 2:
                    out += pieces()
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            claims = b.column("claims").combine_chunks() if isinstance(b.column("claims"), pa.ChunkedArray) else b.column("claims")
            flat = claims.flatten()
            if len(flat):
                text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(claims.offsets)) * np.asarray(claims.is_valid()))
                pos, other_doc, other_tie, other = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "other_doc", "other_tie", "other"))
                named = np.unique(np.stack([other_doc, other_tie]), axis=1, return_inverse=True)
                _, _, t, o, first, last, shift = _spans(text, named[1].reshape(-1), pos, other, np.array([len(x) for x in texts])[text], length, margin)
                for t, o, a, z, d in zip(t.tolist(), named[0][:, o].T.tolist(), first.tolist(), last.tolist(), shift.tolist(), strict=True):
                    salt = salts.get(tuple(o), 1)
                    key = _served(*o, (doc_ids[t] ^ ties[t]) % salt)
                    out.append((key, doc_ids[t], ties[t], a, z, hashlib.sha256(texts[t][a:z]).digest(), CLAIM, *o, a - d))
                    if len(out) >= 20_000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)
        if hot:
            yield batch(pieces())

    return run


def _hashed(doc: int, tie: int, at: int) -> int:
    return (((doc ^ tie) * 0x5851F42D4C957F2D + at) & MASK) - (1 << 63)


class Suffixes:
    """Strings (rows of bytes with their lengths) that are sorted within groups of consecutive rows."""

    def __init__(self, rows: np.ndarray, lens: np.ndarray, starts: np.ndarray):
        self.rows, self.lens, self.starts = rows, lens, starts
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        for i in range(rows.shape[1]):
            self.prefix[:, i + 1] = self.prefix[:, i] * np.uint64(BASE) + rows[:, i] + np.uint64(1)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common leading bytes, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.lens[x], self.lens[y])
        for _ in range(int(self.rows.shape[1]).bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.prefix[x, mid] == self.prefix[y, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(lo, mid - 1))
        return lo

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By the first byte that differs; a prefix comes before the longer string, equal ones by row."""
        n = self.extension(x, y)
        last = self.rows.shape[1] - 1
        a = np.where(n < self.lens[x], self.rows[x, np.minimum(n, last)].astype(np.int64), -1)
        b = np.where(n < self.lens[y], self.rows[y, np.minimum(n, last)].astype(np.int64), -1)
        return np.where(a == b, x < y, a < b)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows in sorted order, and the common extension of each with the one before (0 at a group's start)."""
        n = len(self.rows)
        sizes = np.diff(np.concatenate([self.starts, [n]]))
        group, size = np.repeat(self.starts, sizes), np.repeat(sizes, sizes)
        now, width = np.arange(n), 1
        while width < (sizes.max() if n else 0):
            at = np.flatnonzero(size > width)
            local = at - group[at]
            block = local // width
            lo = group[at] + (block ^ 1) * width
            end = np.minimum(lo + width, group[at] + size[at])
            at, local, block, lo, end = (v[lo < end] for v in (at, local, block, lo, end))
            low, high = lo.copy(), end.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                before = self.less(now[mid], now[at[open_]])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            merged = now.copy()
            merged[group[at] + (block // 2) * 2 * width + local - block * width + low - lo] = now[at]
            now, width = merged, 2 * width
        common = np.zeros(n, np.int64)
        if n > 1:
            common[1:] = self.extension(now[:-1], now[1:])
            common[self.starts] = 0
            if not self._verified(now, common):
                return self._plain(group)
        return now, common

    def _verified(self, now: np.ndarray, common: np.ndarray) -> bool:
        """The bytes themselves: equal up to the common extension, and in order after it."""
        columns = np.arange(self.rows.shape[1])
        inside = np.ones(len(now), bool)
        inside[self.starts] = False
        x, y, n = now[:-1][inside[1:]], now[1:][inside[1:]], common[1:][inside[1:]]
        for s in range(0, len(x), 50_000):
            a, b, c = x[s : s + 50_000], y[s : s + 50_000], n[s : s + 50_000]
            if ((self.rows[a] != self.rows[b]) & (columns < c[:, None])).any():
                return False
            short = c < np.minimum(self.lens[a], self.lens[b])
            if (self.rows[a[short], c[short]] >= self.rows[b[short], c[short]]).any():
                return False
        return True

    def _plain(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After a hash collision: the same by comparing bytes."""
        text = [r[:n].tobytes() for r, n in zip(self.rows, self.lens, strict=True)]
        now = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i], i)))
        common = np.zeros(len(text), np.int64)
        for i in range(1, len(text)):
            a, b = text[now[i - 1]], text[now[i]]
            if group[now[i - 1]] == group[now[i]]:
                common[i] = next((j for j, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        return now, common


def repeated_windows(keys: np.ndarray, codes: np.ndarray, data: list[bytes], length: int, margin: int) -> np.ndarray:
    """Flags [row, l]: the window that starts l bytes before the row's anchor also stands in an earlier row.

    Rows come in groups of equal keys, in document order; data holds the bytes of a row's own windows.
    """
    n = len(keys)
    high, low = codes >> 7 & 127, codes & 127
    right, left = length - low, high
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum([0] + [len(d) for d in data])[:-1] + left
    forward, backward = np.zeros((n, length), np.uint8), np.zeros((n, margin), np.uint8)
    for i in range(length):
        has = i < right
        forward[has, i] = raw[begin[has] + i]
    for i in range(margin):
        has = i < left
        backward[has, i] = raw[begin[has] - 1 - i]
    starts = np.flatnonzero(_runs(keys))
    on, common_on = Suffixes(forward, right, starts).order()
    back, common_back = Suffixes(backward, left, starts).order()
    heads = np.zeros(n, bool)
    heads[starts] = True
    flags = np.zeros((n, margin + 1), bool)
    run_on, run_back = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(margin + 1):
        own = np.flatnonzero((low <= l) & (l <= high))
        if len(own) < 2:
            continue
        run_on[on] = np.cumsum(heads | (common_on < length - l))
        run_back[back] = np.cumsum(heads | (common_back < l))
        pair = run_on[own] * (n + 1) + run_back[own]
        order = np.argsort(pair, kind="stable")
        later = own[order[1:][pair[order[1:]] == pair[order[:-1]]]]
        flags[later, l] = True
    return flags


FOUND = "doc tie first last key data"
FOUND_SCHEMA = "doc long, tie long, first long, last long, key long, data binary"


def _verified(rows: pa.Table, texts: dict[tuple[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """Claimed spans whose digest is that of the bytes they claim to repeat; a false claim is a span from -1."""
    import zstandard

    claims = rows.filter(pc.equal(rows.column("kind"), CLAIM)).sort_by([("other_doc", "ascending"), ("other_tie", "ascending")]).to_pylist()
    now, text, known, out = None, b"", {}, []
    for c in claims:
        if (c["other_doc"], c["other_tie"]) != now:
            now = c["other_doc"], c["other_tie"]
            text, known = zstandard.ZstdDecompressor().decompress(texts[now]), {}
        a, z = c["other"], c["other"] + c["last"] - c["code"]
        if (a, z) not in known:
            known[a, z] = hashlib.sha256(text[a:z]).digest() if 0 <= a and z <= len(text) else b""
        good = known[a, z] == c["data"]
        out.append((c["doc"], c["tie"], c["code"] if good else -1, c["last"] if good else -1))
    if out:
        yield _found(*(np.array(x, np.int64) for x in zip(*out, strict=True)))


def _found(doc, tie, first, last, key=None, data=None) -> pa.RecordBatch:
    return _record(FOUND, doc, tie, first, last, pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key, pa.int64()), pa.nulls(len(doc), pa.binary()) if data is None else pa.array(data, pa.binary()))


def _windows(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Single windows, to be dealt by their bytes; of equal ones among these rows only the first goes on."""
    import xxhash

    for s in range(0, rows.num_rows, 2000):
        part, out = rows.slice(s, 2000), []
        for doc, tie, code, data in zip(*(part.column(c).to_pylist() for c in ("doc", "tie", "code", "data")), strict=True):
            pos, high, low = code >> 14, code >> 7 & 127, code & 127
            out += [(data[high - l : high - l + length], doc, tie, pos - l) for l in range(low, high + 1)]
        out.sort()
        data, doc, tie, first = zip(*out, strict=True)
        again = np.array([i > 0 and data[i] == data[i - 1] for i in range(len(data))])
        doc, tie, first = (np.array(x, np.int64) for x in (doc, tie, first))
        yield _found(doc[again], tie[again], first[again], first[again] + length)
        on = np.flatnonzero(~again)
        data = [data[i] for i in on.tolist()]
        yield _found(doc[on], tie[on], first[on], first[on] + length, [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in data], data)


def _sorter(length: int, k: int, together: int) -> Callable:
    margin = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[int, int], bytes] = {}
        now = None
        for rows, large in _groups(batches, together):
            kind = rows.column("kind").to_numpy()
            # A key's texts come before its claims; a large key's claims may come in several parts.
            if (key := rows.column("key")[0].as_py()) != now:
                now, texts = key, {}
            texts |= {(r["doc"], r["tie"]): r["data"] for r in rows.filter(pa.array(kind == TEXT)).select(["doc", "tie", "data"]).to_pylist()}
            if (kind == FULL).any():
                part = rows.filter(pa.array(kind == FULL))
                yield _found(*(part.column(c).to_numpy() for c in ("doc", "tie", "code", "last")))
            if (kind == CLAIM).any():
                yield from _verified(rows, texts)
            rows = rows.filter(pa.array(kind == NEED))
            if not rows.num_rows:
                continue
            if large:
                yield from _windows(rows, length)
                continue
            key, doc, tie, code = (rows.column(c).to_numpy() for c in ("key", "doc", "tie", "code"))
            order = np.lexsort((code, tie, doc, key))
            key, doc, tie, code = (x[order] for x in (key, doc, tie, code))
            data = rows.column("data").take(pa.array(order)).to_pylist()
            flags = repeated_windows(key, code, data, length, margin)
            edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            pos = code[row] >> 14
            if len(row):
                yield _found(doc[row], tie[row], pos - (b - 1), pos - a + length)

    return run


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, data and place: a window like the one before it repeats an earlier one."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        data = b.column("data").to_pylist()
        again = np.array([x == y for x, y in zip(data, [before, *data], strict=False)])
        before = data[-1]
        if again.any():
            yield _record("doc tie first last", *(b.column(c).filter(pa.array(again)) for c in ("doc", "tie", "first", "last")))


def _with_identity(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with what names a document, and whether an id stands in several rows; the tie is only needed then."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    several = bool(docs.groupBy(doc.alias("d")).count().filter("count > 1").limit(1).count())
    text = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    tie = F.xxhash64(text) if several else F.lit(0).cast("long")
    return docs.withColumns({DOC: doc, TIE: tie, BYTES: text}), several


def _salts(found: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """How many documents claim to repeat each text; for those with over a thousandth of all (at most 1000) over how many keys they are dealt."""
    named = F.array_distinct(F.transform("claims", lambda c: F.struct(c["other_doc"].alias("doc"), c["other_tie"].alias("tie"))))
    served = found.select(F.explode(named).alias("n")).groupBy("n.doc", "n.tie").agg(F.count("*").alias("claimants"))
    served = staged(served, "served")
    total = served.agg(F.coalesce(F.sum("claimants"), F.lit(0))).first()[0]
    most = max(1000, total // 1000)
    return served, {(r["doc"], r["tie"]): -(-r["claimants"] // most) for r in served.filter(F.col("claimants") > most).collect()}


def _repeats(texts: DataFrame, packed: DataFrame, length: int, k: int, most: int, together: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(doc, tie, fulls) and (doc, tie, first, last), the latter with first < 0 for claims that failed."""
    ctx = "binary" if exact else "long"
    anchors = texts.mapInArrow(_anchors(length, k, CONTEXT_BITS, exact), f"key long, ctx {ctx}, doc long, tie long, code long, last long, kind byte")
    settled = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(most, exact), "doc long, tie long, kind byte, key long, code long, last long, other_doc long, other_tie long, other long")
    of = lambda kinds, **fields: F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct(*[c.alias(n) for n, c in fields.items()])))
    found = settled.groupBy("doc", "tie").agg(
        of([FULL], first=F.col("code"), last=F.col("last")).alias("fulls"),
        of([NEED, HOT], key=F.col("key"), code=F.col("code"), kind=F.col("kind")).alias("needs"),
        of([CLAIM], pos=F.shiftright("code", 14), other_doc=F.col("other_doc"), other_tie=F.col("other_tie"), other=F.col("other")).alias("claims"),
    )
    found = staged(found, "anchors")
    served, salts = _salts(found)
    wanted = found.select("doc", "tie", "needs", "claims").filter("size(needs) + size(claims) > 0").join(served, ["doc", "tie"], "full")
    contexts = packed.join(wanted, ["doc", "tie"]).mapInArrow(_contexts(length, k, salts), "key long, doc long, tie long, code long, last long, data binary, kind byte, other_doc long, other_tie long, other long")
    spans = staged(contexts.repartition("key").sortWithinPartitions("key", F.desc("kind")).mapInArrow(_sorter(length, k, together), FOUND_SCHEMA), "spans")
    plain = spans.filter("key is null").select("doc", "tie", "first", "last")
    windows = spans.filter("key is not null")
    if windows.limit(1).count():
        dealt = windows.repartition("key").sortWithinPartitions("key", "data", "doc", "tie", "first")
        plain = plain.unionByName(dealt.mapInArrow(_equal_windows, "doc long, tie long, first long, last long"))
    return found.select("doc", "tie", "fulls"), plain


def repeated_spans(docs: DataFrame, several: bool, length: int = LENGTH, k: int = K, most: int = MOST, together: int = SORTED) -> tuple[DataFrame, DataFrame]:
    """Of docs with identity: the compressed texts, and doc, tie with fulls and spans (first, last: bytes) that repeat."""
    if not k < length < k + 128:
        raise ValueError("length - k must be from 1 to 127")
    texts = docs.select(F.col(DOC).alias("doc"), F.col(TIE).alias("tie"), F.col(BYTES).alias("text"))
    if several:
        texts = texts.dropDuplicates(["doc", "tie"])
    packed = texts.mapInArrow(_deflate, "doc long, tie long, packed binary")
    fulls, spans = _repeats(texts, packed, length, k, most, together, exact=False)
    if spans.filter("first < 0").limit(1).count():
        fulls, spans = _repeats(texts, packed, length, k, most, together, exact=True)
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return packed, fulls.join(spans, ["doc", "tie"], "full")


def kept(text: bytes, fulls: list[dict] | None, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes that stay, and how many runs of bytes go."""
    gone = [(s["first"], s["last"]) for s in [*(spans or ()), *(fulls or ())]]
    parts, at, runs = [], 0, 0
    for a, b in sorted(gone):
        if a > at or not runs:
            parts.append(text[at:a])
            runs += 1
        at = max(at, b)
    return b"".join([*parts, text[at:]]), runs


def _each(make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = (unpack(x) for x in b.column("packed").to_pylist())
            done = [(len(t), *kept(t, f, s)) for t, f, s in zip(texts, b.column("fulls").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield make(b, done)

    return run


def _digests(b: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
    n, left, runs = zip(*done, strict=True) if done else ((), (), ())
    sha = [hashlib.sha256(x).hexdigest() for x in left]
    return pa.RecordBatch.from_arrays(
        [b.column("doc"), b.column("tie"), pa.array(n, pa.int64()), pa.array([a - len(x) for a, x in zip(n, left, strict=True)], pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
        names=["doc", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def report(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST, together: int = SORTED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    docs, several = _with_identity(docs.select("doc_id", "text"))
    packed, found = repeated_spans(docs, several, length, k, most, together)
    out = packed.join(found, ["doc", "tie"], "left").mapInArrow(_each(_digests), "doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if several:
        out = docs.select(F.col(DOC).alias("doc"), F.col(TIE).alias("tie")).join(out, ["doc", "tie"])
    return out.select(F.when(F.col("doc") != FIRST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _cut(b: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("doc"), b.column("tie"), pa.array([x.decode("utf-8", "ignore") for _, x, _ in done], pa.string())], names=["doc", "tie", "text"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST, together: int = SORTED) -> DataFrame:
    """docs, in its own columns, with repeats cut from the texts; a character that a cut splits goes too.

    n_chars, where docs has it, is counted again. A null text becomes an empty one.
    """
    named, several = _with_identity(docs)
    packed, found = repeated_spans(named, several, length, k, most, together)
    cut = packed.join(found, ["doc", "tie"], "left").mapInArrow(_each(_cut), "doc long, tie long, text string").withColumnsRenamed({"doc": DOC, "tie": TIE})
    out = named.drop("text", BYTES).join(cut, [DOC, TIE])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
