"""Fill-in-the-middle texts: each text is cut at two units and its parts are put in prefix, suffix, middle order.

A unit is a run of A-Z and a-z or any other single code point. A text's UTF-8 bytes are taken in
blocks of `BLOCK` bytes. A Fenwick tree over the blocks holds how many units and how many code points
begin in each; the block of a cut is found by binary-lifting descent over the tree and the byte in it by
looking at that block alone. So a cut costs the logarithm of the text's blocks and one block, and the code
points before it come out of the same tree. Cuts and forms follow from a hash of the id, so they do not depend
on partitions, order or retries; rows never leave their task.

Defined results: a null or empty text is plain with 0 units; a null id is hashed as an empty one; repeated
rows are kept, and rows of one id are cut by the same numbers; a text that holds one of the markers is plain;
an empty table gives no rows; further columns stay as they are, but those named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 4096
MARKERS = ("<P>", "<S>", "<M>")
RESULTS = "n long, form string, prefix_chars long, middle_chars long, output string"


class BlockTree:
    """A Fenwick tree over a text's blocks; each node sums the units and the code points that begin in its blocks."""

    def __init__(self, data: bytes, block: int = BLOCK):
        raw = np.frombuffer(data, np.uint8)
        self.size, self.block = len(raw), block
        self.lead = (raw & 0xC0) != 0x80
        letter = ((raw | 0x20) - np.uint8(0x61)) < 26
        self.begins = self.lead.copy()
        self.begins[1:] &= ~(letter[1:] & letter[:-1])
        self.m = -(-len(raw) // block)
        self.tree = np.zeros((self.m + 1, 2), np.int64)
        if self.m:
            edges = np.arange(0, len(raw), block)
            self.tree[1:, 0] = np.add.reduceat(self.begins, edges, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(self.lead, edges, dtype=np.int64)
        step = 1
        while step <= self.m:  # nodes of one lowest bit at a time give to their parents
            child = np.arange(step, self.m + 1 - step, 2 * step)
            self.tree[child + step] += self.tree[child]
            step *= 2
        self.units, self.points = self._before(self.m)

    def _before(self, blocks: int) -> tuple[int, int]:
        units = points = 0
        while blocks:
            units, points = units + int(self.tree[blocks, 0]), points + int(self.tree[blocks, 1])
            blocks &= blocks - 1
        return units, points

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the k-th unit, counted from 0; the whole text for k = units."""
        if k >= self.units:
            return self.size, self.points
        at, points, left = 0, 0, k
        step = 1 << self.m.bit_length()
        while step:
            if at + step <= self.m and self.tree[at + step, 0] <= left:
                at += step
                left -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        low = at * self.block
        byte = int(np.flatnonzero(self.begins[low : low + self.block])[left])
        return low + byte, points + int(np.count_nonzero(self.lead[low : low + byte]))


def draws(key: str) -> list[int]:
    """The first four 8-digit groups of the key's hexadecimal SHA-256."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _cutter(seed: int, markers: tuple[str, str, str], plain: int, spm: int, block: int, names: list[str]) -> Callable:
    marks = [m.encode() for m in markers]

    def one(i: int | None, data: bytes) -> tuple:
        tree = BlockTree(data, block)
        h1, h2, h3, h4 = draws(f"{seed}:{'' if i is None else i}")
        if not data or h3 % 100 >= 100 - plain or any(m in data for m in marks):
            return tree.units, "plain", None, None, data
        low, high = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
        (a, a_points), (b, b_points) = tree.cut(low), tree.cut(high)
        p, s, m = marks
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        if h4 % 100 < spm:
            return tree.units, "spm", a_points, b_points - a_points, b"".join((s, suffix, p, prefix, m, middle))
        return tree.units, "psm", a_points, b_points - a_points, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = [one(i, d) for i, d in zip(part.column("id").to_pylist(), part.column("data").to_pylist(), strict=True)]
                columns = list(zip(*out, strict=True))
                made = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=["row", *names])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, markers: tuple[str, str, str] = MARKERS, plain: int = 10, spm: int = 20, block: int = BLOCK) -> DataFrame:
    """docs without the text, with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    `plain` in a hundred texts stay as they are, `spm` in a hundred of the others put the suffix first.
    """
    names = [f.split()[0] for f in RESULTS.split(", ")]
    kept = [c for c in docs.columns if c != text_col and c not in names]
    row = F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8").alias("data"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {RESULTS}"
    out = rows.mapInArrow(_cutter(seed, markers, plain, spm, block, names), schema)
    return out.select(*[out["row"].getField(c).alias(c) for c in kept], *names)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. No text between markers holds one, so each marker stands where it is first found."""
    p, s, m = (F.lit(x) for x in markers)

    def after(mark: Column, text: Column) -> Column:
        return F.split_part(text, mark, F.lit(2))

    def until(mark: Column, text: Column) -> Column:
        return F.split_part(text, mark, F.lit(1))

    psm = F.concat(until(s, after(p, output)), after(m, output), until(m, after(s, output)))
    spm = F.concat(until(m, after(p, output)), after(m, output), until(p, after(s, output)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle_fenwick(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(out["output"], out["form"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {"op12_fill_middle_fenwick": op12_fill_middle_fenwick}
ORACLES = {
    "op12_fill_middle_fenwick": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS s, sha256(concat('1:', doc_id)) AS x FROM documents),
h AS (SELECT doc_id, s, regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE s END) AS output_sha256,
  sha256(s) AS restored_sha256
FROM p"""
}
