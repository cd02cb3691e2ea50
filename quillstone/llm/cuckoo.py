"""A cuckoo filter over 128-bit keys, in NumPy: whole arrays of keys are looked up, inserted and removed at a time."""

from __future__ import annotations

import numpy as np

SLOTS, LOAD, ROUNDS = 4, 0.9, 200


def _firsts(ordered: np.ndarray) -> np.ndarray:
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """The place of each entry of a sorted array among those equal to it."""
    at = np.arange(len(ordered))
    return at - np.maximum.accumulate(np.where(_firsts(ordered), at, 0))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lies in one of two buckets, each found from the other and the fingerprint.

    Keys are two arrays of 64-bit integers; the low one gives bucket and fingerprint. Each key must be inserted once
    only, and only inserted keys removed: then no inserted key is ever denied, and others are affirmed at a rate of
    about 8 / 65536. What finds no place after ROUNDS rounds of moves is kept exactly in a list, so nothing is lost.
    """

    def __init__(self, slots: np.ndarray, spare: np.ndarray):
        self.slots, self.spare = slots, spare
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * LOAD < n:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, np.uint64))

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        buckets = int.from_bytes(data[:8], "little")
        end = 8 + buckets * SLOTS * 2
        return cls(np.frombuffer(data[8:end], np.uint16).reshape(buckets, SLOTS).copy(), np.frombuffer(data[end:], np.uint64).copy())

    def to_bytes(self) -> bytes:
        return len(self.slots).to_bytes(8, "little") + self.slots.tobytes() + self.spare.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots)) + len(self.spare)

    @property
    def room(self) -> int:
        """How many more keys it should take."""
        return int(self.slots.size * LOAD) - len(self)

    def _at(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = low.astype(np.int64).view(np.uint64)
        mark = np.maximum(low >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return mark, low & self.mask

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & self.mask)

    def _name(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """One number for a fingerprint and its pair of buckets."""
        return np.minimum(bucket, self._other(mark, bucket)) << np.uint64(16) | mark.astype(np.uint64)

    def contains(self, low: np.ndarray) -> np.ndarray:
        mark, bucket = self._at(low)
        hit = (self.slots[bucket] == mark[:, None]).any(axis=1) | (self.slots[self._other(mark, bucket)] == mark[:, None]).any(axis=1)
        if len(self.spare):
            hit |= np.isin(self._name(mark, bucket), self.spare)
        return hit

    def insert(self, low: np.ndarray) -> None:
        mark, bucket = self._at(low)
        random = np.random.default_rng(len(mark))  # the same in every attempt of a task
        for turn in range(ROUNDS):
            if not len(mark):
                return
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            rank = _ranks(bucket)
            free = self.slots[bucket] == 0
            nth = np.cumsum(free, axis=1)
            fits = nth[:, -1] > rank
            slot = np.argmax(free & (nth == rank[:, None] + 1), axis=1)
            self.slots[bucket[fits], slot[fits]] = mark[fits]
            mark, bucket = mark[~fits], bucket[~fits]
            if turn:  # one newcomer a bucket takes a place there; who had it moves on
                first = _firsts(bucket)
                slot = random.integers(0, SLOTS, int(first.sum()))
                out = self.slots[bucket[first], slot]
                self.slots[bucket[first], slot] = mark[first]
                mark[first] = out
            bucket = self._other(mark, bucket)
        self.spare = np.concatenate([self.spare, self._name(mark, bucket)])

    def remove(self, low: np.ndarray) -> None:
        mark, bucket = self._at(low)
        name = self._name(mark, bucket)
        order = np.argsort(name, kind="stable")
        mark, bucket, name = mark[order], bucket[order], name[order]
        rank = _ranks(name)
        for k in range(int(rank.max(initial=-1)) + 1):  # those of one name one after another, all names at once
            m, b, n = mark[rank == k], bucket[rank == k], name[rank == k]
            for _ in range(2):
                match = self.slots[b] == m[:, None]
                found = match.any(axis=1)
                self.slots[b[found], np.argmax(match[found], axis=1)] = 0
                m, b, n = m[~found], self._other(m, b)[~found], n[~found]
            for x in n:
                self.spare = np.delete(self.spare, np.flatnonzero(self.spare == x)[:1])
