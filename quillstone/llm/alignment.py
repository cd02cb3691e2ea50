"""Alignment of two tokenizers' ids over the same bytes, and how often ids end together in the whole corpus.

Neither tokenizer joins anything over a single space between two other letters (the first cuts its words there, and
no piece of the second has a space after a letter, which is asked of its vocabulary), so a text is the sum of its parts
between such spaces, each with its space before it. A task encodes each distinct part by both tokenizers, many of them joined by
such spaces at a time, takes the running byte ends of each id list to their places, and intersects the two sets of ends.
The common ends, sorted, slice both lists into groups; in each slice the tokens whose ranges end at its end are linked,
each with each (one pair, unless a token has no bytes). What a text needs later is staged with it: its distinct linked
pairs and how often each occurs.

Counts are summed over the corpus by pair: in a task first, then by Spark. Pairs with at least one in
`FREQUENT` of all links are at most `FREQUENT`, so their counts are broadcast (16 bytes each); only rarer pairs of
a text, each of them under that share of the links, are joined with their counts by a shuffle. The highest count of
each id of the second tokenizer has one entry an id of its vocabulary and is broadcast as well.

Defined results: a null or empty text, and one whose joined token bytes are not the text with a space before
it, has no tokens (zeros, no groups); null and repeated ids are kept as rows of their own; all rows count,
repeated ones each time; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, worker_cache

SPACE = "▁"  # stands for the space in the second tokenizer's pieces
FREQUENT, HELD = 1_000_000, 1_000_000
SLICE_BYTES, SLICE_PAIRS = 1 << 19, 250_000  # what a task works on at a time, whatever Arrow's batches hold
LONGEST, HEAVIEST, KEPT = 40, 400, 150_000  # letters, bytes found and number of the parts that a worker keeps, twice over
JOINED = 64
BORDER = re.compile(r" (?<=\S )(?=\S)")
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others in order from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def _file(path: str | None, name: str) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


class Sides:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, path_a: str | None, path_b: str | None):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        self.a = Tokenizer.from_file(_file(path_a, "byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        letters = byte_letters()
        known = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, token)) if all(map(letters.__contains__, token)) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=_file(path_b, "piece_bpe_32k.model"))
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = ([len(x) for x in side] for side in (self.bytes_a, self.bytes_b))
        self.empty = 0 in self.size_a or 0 in self.size_b
        # Where the second has no piece that goes on over a space, and the first cuts its words before each, parts are encoded apart.
        cut = '"ByteLevel"' in (first := self.a.pre_tokenizer.__getstate__().decode() if self.a.pre_tokenizer else "") and '"use_regex":false' not in first
        self.apart = cut and not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size()))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        # The same for whole arrays of ids: letters to the right, a last column for what follows, and which of them count.
        self.width = len(self.names[-1])
        self.letters = np.array([f"{x:>{self.width + 1}}" for x in (f"{x} " for x in self.names)], f"S{self.width + 1}").view(np.uint8).reshape(len(self.names), -1)
        self.counted = np.arange(self.width + 1) >= (self.width - np.array([len(x) for x in self.names]))[:, None]
        self.ends_a, self.ends_b = np.array(self.size_a), np.array(self.size_b)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def parts(self, text: str) -> list[str]:
        """The parts of a text that both tokenizers encode each by itself, without the space before each."""
        return BORDER.split(text) if self.apart else [text]

    def found(self, parts: list[str]) -> dict[str, tuple | None]:
        """What align gives for each part, none where the bytes of its tokens are not its own."""
        together = [p for p in parts if not (p[0].isspace() or p[-1].isspace())] if self.apart and not self.empty else []
        blocks, out = [together[k : k + JOINED] for k in range(0, len(together), JOINED)], {}
        same = [(block, a, b) for block, a, b in zip(blocks, *self._ids([" ".join(x) for x in blocks]), strict=True) if a]
        if same:
            out = align_blocks(self, *(list(chain.from_iterable(x)) for x in zip(*same, strict=True)))
        alone = [p for p in parts if p not in out]
        out.update((p, align(self, a, b) if a else None) for p, a, b in zip(alone, *self._ids(alone), strict=True))
        return out

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each text by both tokenizers, none where the bytes of its tokens are not its own."""
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1) if texts else []
        for k, t in enumerate(texts):
            if not b"".join(map(self.bytes_a.__getitem__, ids_a[k])) == b" " + t.encode() == b"".join(map(self.bytes_b.__getitem__, ids_b[k])):
                ids_a[k] = ids_b[k] = []
        return ids_a, ids_b


def sides(path_a: str | None = None, path_b: str | None = None) -> Sides:
    """The tokenizers, once per worker."""
    kept = worker_cache("alignment")
    key = path_a, path_b
    if key not in kept:
        kept[key] = Sides(path_a, path_b)
    return kept[key]


def slices(size_a: list[int], size_b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups of two lists of token sizes over the same bytes, as (from, to) in the first and in the second list.

    A dictionary keeps the last place of each end, so tokens without bytes belong to the group that ends where they stand.
    """
    place_a = dict(zip(accumulate(size_a), range(1, len(size_a) + 1), strict=True))
    place_b = dict(zip(accumulate(size_b), range(1, len(size_b) + 1), strict=True))
    ends = sorted(place_a.keys() & place_b.keys())
    out, a, b = [], 0, 0
    for e in ends:
        a_to, b_to = place_a[e], place_b[e]
        out.append((a, a_to, b, b_to))
        a, b = a_to, b_to
    return out


def ending(sizes: list[int], low: int, high: int) -> int:
    """From where on in a slice tokens end where the slice ends: its last one, and before it as long as what follows has no bytes."""
    at = high - 1
    while at > low and sizes[at] == 0:
        at -= 1
    return at


def align(s: Sides, a: list[int], b: list[int]) -> tuple[int, int, int, bytes, bytes]:
    """n_a, n_b, n_groups, the groups' ids as text, and the links (first id * 2**32 + second id) of two id lists over the same bytes."""
    size_a, size_b = [s.size_a[i] for i in a], [s.size_b[i] for i in b]
    cut = slices(size_a, size_b)
    name = s.names.__getitem__
    groups = ";".join([f"{','.join(map(name, a[i:j]))}|{','.join(map(name, b[k:m]))}" for i, j, k, m in cut])
    links = [a[x] << 32 | b[y] for i, j, k, m in cut for x in range(ending(size_a, i, j), j) for y in range(ending(size_b, k, m), m)]
    return len(a), len(b), len(cut), groups.encode(), np.array(links, np.int64).tobytes()


def align_blocks(s: Sides, parts: list[str], a: list[int], b: list[int]) -> dict[str, tuple[int, int, int, bytes, bytes]]:
    """align for each of many parts, from the ids of all, one part after another; no token is without bytes. Parts that a token goes beyond are left out."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    end_a, end_b = np.cumsum(s.ends_a[a]), np.cumsum(s.ends_b[b])
    end = np.cumsum([len(p.encode()) + 1 for p in parts])
    in_a, in_b = np.zeros((2, end[-1] + 1), bool)
    in_a[end_a] = in_b[end_b] = True
    last_a, last_b = in_b[end_a], in_a[end_b]  # the last token of each group
    group_a, group_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    links = (a[last_a] << 32 | b[last_b]).tobytes()
    # Ids in the order of the text of groups: before an id of the first list stand those of the second in earlier groups, and so on.
    at_a = np.arange(len(a)) + np.append(0, group_b)[np.cumsum(last_a) - last_a]
    at_b = np.arange(len(b)) + group_a[np.cumsum(last_b) - last_b]
    ids, after = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[at_a], after[at_a] = a, np.where(last_a, ord("|"), ord(","))
    ids[at_b], after[at_b] = b, np.where(last_b, ord(";"), ord(","))
    letters, counted = s.letters[ids], s.counted[ids]
    letters[:, -1] = after
    groups = letters[counted].tobytes()
    text_to = np.append(0, np.cumsum(counted.sum(1)))
    to_a, to_b = (np.append(0, np.searchsorted(x, end, "right")) for x in (end_a, end_b))
    to_group = np.searchsorted(group_a, to_a, "right")
    to_text = text_to[to_a + to_b]
    whole = in_a[end] & in_b[end]
    whole &= np.append(True, whole[:-1])
    n_a, n_b, n_groups = (np.diff(x).tolist() for x in (to_a, to_b, to_group))
    t, g = to_text.tolist(), (to_group * 8).tolist()
    return {p: (n_a[k], n_b[k], n_groups[k], groups[t[k] : t[k + 1] - 1], links[g[k] : g[k + 1]]) for k, p in enumerate(parts) if whole[k]}


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))


def summed(found: list[tuple | None]) -> tuple:
    """The figures of a text from those of its parts: n_a, n_b, n_groups, n_links, hash of the groups, distinct links and how often each occurs."""
    if not found or not all(found):
        return NOTHING
    n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
    links = np.frombuffer(b"".join(links), np.int64)
    pairs, times = np.unique(links, return_counts=True)
    return sum(n_a), sum(n_b), sum(n_groups), len(links), hashlib.sha256(b";".join(groups)).hexdigest(), pairs, times.astype(np.int32)


def sliced(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of rows whose sizes add up to at most `most`, or of one row."""
    ends, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with a bounded number of pairs, these pairs and how often each occurs. What a worker kept for encoding is let go."""
    if kept := worker_cache("aligned"):
        kept.clear()
        gc.unfreeze()
        gc.collect()
        pa.default_memory_pool().release_unused()
    for batch in batches:
        for b in sliced(batch, batch.column("pairs").value_lengths().to_numpy(), SLICE_PAIRS):
            yield b, b.column("pairs").flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)


def lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    """A list for each of arrays."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *arrays])))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each of docs (ALIGNED), staged: each text is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(path_a, path_b)
        kept = worker_cache("aligned").setdefault((path_a, path_b), {})
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for rows in sliced(batch, pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), SLICE_BYTES):
                parts = [s.parts(t) if t else [] for t in rows.column("text").to_pylist()]
                young, old = kept.get("young", {}), kept.get("old", {})
                if len(young) > KEPT:
                    young, old = {}, young  # what is met again before the next turn comes back from the old ones
                unseen = set(chain.from_iterable(parts)) - young.keys()
                misses = list(unseen - old.keys())
                young.update((p, old[p]) for p in unseen & old.keys())
                young.update(s.found(misses))
                gc.freeze()  # the collector need not look through what is kept again and again
                made = [summed(list(map(young.__getitem__, text))) for text in parts]
                for p in misses:
                    if len(p) > LONGEST or young[p] and len(young[p][3]) + len(young[p][4]) > HEAVIEST:
                        del young[p]
                kept["young"], kept["old"] = young, old
                more = [pa.array([x[f] for x in made], kind) for f, kind in enumerate(kinds)]
                more += [lists([x[5] for x in made], np.int64), lists([x[6] for x in made], np.int32)]
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *more], names=[f.split()[0] for f in ALIGNED.split(", ")])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return staged(rows.mapInArrow(run, ALIGNED), "aligned")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by pair inside a task, of at most HELD pairs at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in held]).astype(np.float64), len(pairs)).astype(np.int64)

    def out(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    for _, pairs, times in pairs_of(batches):
        held.append((pairs, times))
        size += len(pairs)
        if size > HELD:
            held = [fold()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*fold())


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold it; staged."""
    return staged(rows.select("pairs", "times").mapInArrow(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def link_counts(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """rows without their pairs, with n_best (links whose count is the highest of their second id) and count_sum."""
    spark = rows.sparkSession
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(low.cast("int").alias("b")).agg(F.max("n").alias("top")).toPandas()  # one row an id of the second vocabulary
    tops = np.zeros(int(best["b"].max()) + 1 if len(best) else 1, np.int64)
    tops[best["b"].to_numpy(np.int64)] = best["top"].to_numpy(np.int64)
    links = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent >= F.lit(links)  # true of at most `frequent` pairs
    head = counts.filter(often).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, tops = sent.value
        for b, pairs, times in pairs_of(batches):
            doc = np.repeat(np.arange(b.num_rows), b.column("pairs").value_lengths().to_numpy())
            at = np.searchsorted(known, pairs)
            hit = np.zeros(len(pairs), bool)
            hit[at < len(known)] = known[at[at < len(known)]] == pairs[at < len(known)]
            count = np.zeros(len(pairs), np.int64)
            count[hit] = n[at[hit]]
            total, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(total, doc[hit], (count * times)[hit])
            best = hit & (count == tops[pairs & ((1 << 32) - 1)])
            np.add.at(top, doc[best], times[best])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=b.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (pairs, times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array(top), pa.array(total), *rest], names=[*plain, "n_best", "count_sum", "pairs", "times"])

    plain = [c for c in rows.columns if c not in ("pairs", "times")]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in plain)
    found = staged(rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<int>"), "found")
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    # Ids of the second vocabulary bound the tops, so they go by broadcast; a rare pair has few links, so no key of the join is large.
    tail = counts.filter(~often).withColumn("b", low.cast("int")).join(F.broadcast(spark.createDataFrame(best, "b int, top long")), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    more = rare.join(tail, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    out = found.drop("pairs", "times").join(more, "row", "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("more_best", "more_sum")


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(a row for each of docs with its figures; the table a_id, b_id, n of linked ids)."""
    rows = aligned(docs, id_col, text_col, path_a, path_b)
    counts = pair_counts(rows)
    table_ = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n")
    return link_counts(rows, counts, frequent).drop("row"), table_


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = align_tokens(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_align_tokenizers": op13_align_tokenizers}
#: SQL has no tokenizer, so the query is held against a brute-force version in tests/llm.
ORACLES: dict[str, str] = {}
