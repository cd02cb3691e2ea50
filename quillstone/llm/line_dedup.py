"""Lines that repeat across documents, removed by an index that takes documents in and out again.

A line's key is the line stripped of ASCII white space with A-Z in lower case, known by a 128-bit BLAKE2b
hash; keys of under `least` code points are left alone. The index keeps, per generation (an insertion or a deletion):

- `postings`: a row for each key and document, with the places of its lines. Written by the tasks that read the texts, not shuffled.
- `counts`: the exact references (documents), the owner (smallest id) and the largest id of each key that the
  generation touched. The latest generation of a key holds.
- `filters`: a cuckoo filter a shard, dealt by the key's hash, over all keys that have references.

An insertion sums its postings by key (in each task before the shuffle) and asks the shard's filter. What the filter
denies is new and goes into filter and counts as it is; only what it affirms is joined with the counts of
earlier generations. A key affirmed by mistake is inserted once more, so that each live key has its own entry.
A deletion counts the keys of the leaving documents again from the postings that stay, names their next owners and
takes keys without references out of the filters, so a deletion undoes an insertion. A filter that would be
over-full is built anew, at a fitting size, from the counts of its shard. Every step is a table in the shared folder;
a generation counts once its line in the manifest is written, so a broken one is written over.

Defined results: a null or empty text is one empty line; documents are told apart by id, and rows without an id are
together one document after all others; rows of one id keep or lose the same keys; lines of a key inside its
owner stay, repeated ones too; an empty table gives no rows; further columns stay, but those named like a result give way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, file_system, numbered, shared_dir, staged, table
from .components import join_hot
from .cuckoo import CuckooFilter

LEAST, INCREMENTS = 10, 2
#: Keys for a shard's filter, about; and the fewest shards.
SHARD_KEYS, SHARDS = 1_000_000, 64
LAST_ID = 2**63 - 1
POSTINGS = "hi long, lo long, doc long, row long, lines array<int>"
COUNTS = "hi long, lo long, refs long, owner long, last long"
ASKED = f"shard int, {COUNTS}, hit boolean, held long, filter binary"


def keys_of(data: bytes, least: int = LEAST) -> dict[bytes, list[int]]:
    """The places of the lines of each key in a text. A-Z and white space are single bytes, so a text is lowered and stripped as UTF-8."""
    places: dict[bytes, list[int]] = {}
    for k, line in enumerate(data.lower().split(b"\n")):
        key = line.strip()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            places.setdefault(key, []).append(k)
    return places


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each key and row of numbered docs (POSTINGS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [keys_of(d, least) for d in part.column("data").to_pylist()]
                hashes = np.frombuffer(b"".join([blake2b(key, digest_size=16).digest() for f in found for key in f]), np.int64).reshape(-1, 2)
                per = [len(f) for f in found]
                doc, row = (np.repeat(part.column(c).to_numpy(), per) for c in ("doc", "row"))
                lines = pa.array([p for f in found for p in f.values()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(doc), pa.array(row), lines], names=[f.split()[0] for f in POSTINGS.split(", ")])

    doc = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID))
    rows = docs.select(doc.alias("doc"), docs[ROW].alias("row"), F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8").alias("data"))
    return rows.mapInArrow(run, POSTINGS)


def _ask(size: int):
    """Per shard: new keys and the filter; whether the filter affirms each, and the filter with the others in it."""

    def run(new: pa.Table, filters: pa.Table) -> pa.Table:
        shard = (new if new.num_rows else filters).column("shard")[0].as_py()
        known = new.column("known").to_numpy()
        low = new.column("lo").to_numpy()
        if filters.num_rows and not known.any():
            held = CuckooFilter.of_bytes(filters.column("filter")[0].as_py())
        else:  # none yet, or over-full: built anew from the known keys
            held = CuckooFilter.sized(max(len(low), size))
            held.insert(low[known])
        new, low = new.filter(pa.array(~known)), low[~known]
        hit = held.contains(low)
        held.insert(low[~hit])
        out = new.select([f.split()[0] for f in COUNTS.split(", ")])
        names = ["shard", *out.column_names, "hit", "held", "filter"]
        n = len(low)
        keys = pa.table([pa.array(np.full(n, shard, np.int32)), *out.columns, pa.array(hit), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        blob = pa.table([pa.array([shard], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in out.columns), pa.nulls(1, pa.bool_()), pa.array([len(held)], pa.int64()), pa.array([held.to_bytes()], pa.binary())], names)
        return pa.concat_tables([keys.cast(blob.schema), blob])

    return run


def _change(removing: bool):
    """Per shard: its filter with keys put in or taken out."""

    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        held = CuckooFilter.of_bytes(filters.column("filter")[0].as_py())
        if keys.num_rows:
            (held.remove if removing else held.insert)(keys.column("lo").to_numpy())
        return pa.table([filters.column("shard").combine_chunks(), pa.array([len(held)], pa.int64()), pa.array([held.to_bytes()], pa.binary())], ["shard", "held", "filter"])

    return run


class LineIndex:
    """The index in a shared folder; opened again by its path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}/lines"
        try:
            rows = spark.read.schema("generation int, kind string, shards int").json(f"{self.path}/manifest").collect()  # a row a generation
        except Exception as e:  # a new index has no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        self.made: list[tuple[int, str, int]] = sorted(tuple(r) for r in rows)

    @property
    def shards(self) -> int:
        return self.made[-1][2] if self.made else 0

    def _where(self, generation: int, name: str) -> str:
        return f"{self.path}/{name}/generation={generation}"

    def _write(self, df: DataFrame, generation: int, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self._where(generation, name))
        return self.spark.read.schema(df.schema).parquet(self._where(generation, name))

    def _read(self, name: str, schema: str, kinds: tuple[str, ...]) -> DataFrame:
        """The rows of all generations, with their generation."""
        out = self.spark.createDataFrame([], f"{schema}, generation int")
        for g, kind, _ in self.made:
            if kind in kinds:
                out = out.unionByName(self.spark.read.schema(schema).parquet(self._where(g, name)).withColumn("generation", F.lit(g)))
        return out

    def _done(self, generation: int, kind: str, shards: int) -> None:
        self.spark.createDataFrame([(generation, kind, shards)], "generation int, kind string, shards int").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.made.append((generation, kind, shards))

    def postings(self) -> DataFrame:
        """The postings of the documents that are in: those not deleted in a later generation."""
        rows = self._read("postings", POSTINGS, ("insert",))
        if not any(kind == "delete" for _, kind, _ in self.made):
            return rows.drop("generation")
        gone = self._read("gone", "doc long", ("delete",)).groupBy("doc").agg(F.max("generation").alias("until"))
        return rows.join(gone, "doc", "left").filter("until IS NULL OR until < generation").select(*[f.split()[0] for f in POSTINGS.split(", ")])

    def counts(self) -> DataFrame:
        """The exact table: references, owner and largest id of each key, as its latest generation has them."""
        rows = self._read("counts", COUNTS, ("insert", "delete"))
        if len(self.made) > 1:
            rows = rows.groupBy("hi", "lo").agg(F.max_by(F.struct("refs", "owner", "last"), "generation").alias("c")).select("hi", "lo", "c.refs", "c.owner", "c.last")
        return rows.drop("generation").filter("refs > 0")

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, held long, filter binary").parquet(self._where(self.made[-1][0], "filters"))

    def _shard(self, shards: int):
        return F.col("hi").bitwiseAND(F.lit(shards - 1)).cast("int")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> None:
        """Documents come in. Ids that are in already count as the same document."""
        self.add(postings(docs.withColumn(ROW, F.monotonically_increasing_id()), id_col, text_col, least))

    def add(self, rows: DataFrame, expected: int = 0) -> None:
        """Postings come in; expected: how many there will be in all, for the size of the filters."""
        g = len(self.made)
        rows = self._write(rows, g, "postings")
        new = staged(rows.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last")), "keys")
        n, shards = max(new.count(), expected), max(SHARDS, self.shards)
        if g:
            n += self.filters().agg(F.sum("held")).first()[0] or 0
        while n > 2 * shards * SHARD_KEYS:
            shards *= 2
        new = new.withColumn("shard", self._shard(shards)).withColumn("known", F.lit(False))
        if g and shards == self.shards:
            filters = self.filters()
            # What the filter holds and what comes, against its slots (two bytes each, after the header).
            much = filters.join(new.groupBy("shard").agg(F.count("*").alias("more")), "shard").filter(F.col("held") + F.col("more") > F.octet_length("filter") / 2 * 0.9).select("shard")
            over = much if much.count() else None
        else:  # new, or dealt anew over more shards
            filters, over = self.spark.createDataFrame([], "shard int, held long, filter binary"), new.select("shard").distinct() if g else None
        if over is not None:
            old = self.counts().withColumn("shard", self._shard(shards)).withColumn("known", F.lit(True))
            new = new.unionByName(old.join(over, "shard", "left_semi") if shards == self.shards else old)
        asked = staged(new.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_ask(-(-n // shards)), ASKED), "asked")
        keys, filters = asked.filter("filter IS NULL").drop("held", "filter"), asked.filter("filter IS NOT NULL").select("shard", "held", "filter")
        fields = [f.split()[0] for f in COUNTS.split(", ")]
        fresh = keys.filter("NOT hit").select(*fields)
        if g:
            # Only what the filters affirmed meets the exact table.
            old = self._read("counts", COUNTS, ("insert", "delete")).join(keys.filter("hit").select("hi", "lo"), ["hi", "lo"], "left_semi")
            old = old.groupBy("hi", "lo").agg(F.max_by(F.struct("refs", "owner", "last"), "generation").alias("old"))
            met = staged(keys.filter("hit").join(old, ["hi", "lo"], "left").withColumn("again", F.coalesce(F.col("old.refs") > 0, F.lit(False))), "met")
            sums = [(F.col("refs") + F.col("old.refs")).alias("refs"), F.least("owner", "old.owner").alias("owner"), F.greatest("last", "old.last").alias("last")]
            twins = met.filter("NOT again")
            fresh = fresh.unionByName(met.filter("again").select("hi", "lo", *sums)).unionByName(twins.select(*fields))
        else:
            twins = keys.filter("hit")  # of one batch: keys are distinct, so each affirmed one is another's twin
            fresh = fresh.unionByName(twins.select(*fields))
        self._write(fresh, g, "counts")
        self._write(twins.select("shard", "lo").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_change(False), "shard int, held long, filter binary"), g, "filters")
        self._done(g, "insert", shards)

    def delete(self, ids: DataFrame) -> None:
        """Documents go, by the ids in the one column of ids; ids that are not in do nothing."""
        g = len(self.made)
        if not g:
            return
        ids = ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(LAST_ID)).alias("doc")).distinct()
        touched = staged(self.postings().join(ids, "doc", "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("gone")), "touched")
        self._write(ids, g, "gone")
        stay = self.postings().join(ids, "doc", "left_anti").groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last"))
        now = self._write(touched.join(stay, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("refs", F.lit(0)).alias("refs"), "owner", "last"), g, "counts")
        free = now.filter("refs = 0").withColumn("shard", self._shard(self.shards)).select("shard", "lo")
        self._write(free.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_change(True), "shard int, held long, filter binary"), g, "filters")
        self._done(g, "delete", self.shards)

    def drops(self, rows: DataFrame) -> DataFrame:
        """row, lines: the places to drop among postings of numbered rows, whose documents need not all be in the index."""
        shared = self.counts().filter("owner < last").select(F.struct("hi", "lo").alias("key"), "refs", "owner")
        rows = staged(rows.select(F.struct("hi", "lo").alias("key"), "doc", "row", "lines"), "lines")
        return join_hot(rows, shared, "key", rows.count(), "refs").filter("doc > owner").select("row", "lines")


def without_lines(docs: DataFrame, drops: DataFrame, text_col: str = "text") -> DataFrame:
    """Numbered docs without the stated lines (row, lines), with n_lines before and n_dropped; docs are not shuffled.

    Drops are written in order of rows, in a folder for 64 partitions; a task reads the row groups that its own rows are in.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}/drops"
    drops = staged(drops.select("row", "lines", F.shiftright("row", 33 + 6).alias("file")), "places")
    drops.repartitionByRange("row", "lines").sortWithinPartitions("file", "row").write.partitionBy("file").option("parquet.block.size", 8 << 20).parquet(path)
    kept = [c for c in docs.columns if c not in (ROW, text_col, "n_lines", "n_dropped")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = file_system(path)
        groups: dict[int, list[tuple[int, int, pq.ParquetFile, int]]] = {}
        read: dict[tuple[int, int], pa.Table] = {}

        def groups_of(file: int) -> list:
            if file not in groups:
                groups[file] = []
                for x in store.get_file_info(fs.FileSelector(f"{root}/file={file}", allow_not_found=True)):
                    if x.path.endswith(".parquet"):
                        f = pq.ParquetFile(store.open_input_file(x.path))
                        for k in range(f.num_row_groups):
                            s = f.metadata.row_group(k).column(f.schema_arrow.get_field_index("row")).statistics
                            groups[file].append((s.min, s.max, f, k))
            return groups[file]

        def places(low: int, high: int) -> dict[int, set[int]]:
            out: dict[int, set[int]] = {}
            wanted = [(low >> 39, g) for g, (least, most, _, _) in enumerate(groups_of(low >> 39)) if least <= high and most >= low]
            for old in [x for x in read if x not in wanted]:
                del read[old]
            for k, g in wanted:
                if (k, g) not in read:
                    _, _, f, n = groups[k][g]
                    read[k, g] = f.read_row_group(n, ["row", "lines"])
                t = read[k, g]
                row = t.column("row").to_numpy()
                a, b = np.searchsorted(row, [low, high + 1])
                t = t.slice(a, b - a)
                for r, lines in zip(t.column("row").to_pylist(), t.column("lines").to_pylist(), strict=True):
                    out.setdefault(r, set()).update(lines)
            return out

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                number = part.column("number").to_numpy()
                gone: dict[int, set[int]] = {}
                for p in np.unique(number >> 33).tolist():  # one numbering partition after another
                    own = number[number >> 33 == p]
                    gone |= places(int(own.min()), int(own.max()))
                texts, lines, dropped = [], [], []
                for i, text in zip(number.tolist(), part.column("text").to_pylist(), strict=True):
                    n = (text or "").count("\n") + 1
                    out = gone.get(i)
                    texts.append("\n".join([x for j, x in enumerate(text.split("\n")) if j not in out]) if out else text)
                    lines.append(n)
                    dropped.append(len(out) if out else 0)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    row = F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    packed = docs.select(docs[ROW].alias("number"), row.alias("row"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, t) for c, t in (("text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())))])
    out = packed.mapInArrow(run, schema)
    order = [c for c in docs.columns if c in kept or c == text_col]
    return out.select(*[out["text"].alias(c) if c == text_col else out["row"].getField(c).alias(c) for c in order], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, increments: int = INCREMENTS, index: LineIndex | None = None) -> DataFrame:
    """docs without lines whose key an earlier document holds, with n_lines and n_dropped; the documents are then in the index.

    Texts are read once for their keys. They come in by increments of whole partitions, so a shard's task
    holds the keys of one increment and its filter, never all keys.
    """
    docs = numbered(docs)
    index = index or LineIndex(docs.sparkSession)
    rows = staged(postings(docs, id_col, text_col, least), "postings")
    total = rows.count()
    for k in range(increments):
        index.add(rows.filter(F.pmod(F.shiftright("row", 33), F.lit(increments)) == k), total)
    return without_lines(docs, index.drops(rows), text_col)


def apply_index(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs as the index now says, for documents that are in it (after others came or went)."""
    docs = numbered(docs)
    return without_lines(docs, index.drops(postings(docs, id_col, text_col, least)), text_col)


def op11_line_dedup_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op11_line_dedup_cuckoo": op11_line_dedup_cuckoo}
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES = {
    "op11_line_dedup_cuckoo": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.*, s.owner IS NOT NULL AND k.doc_id > s.owner AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
}
