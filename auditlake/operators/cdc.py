"""A table kept by applying batches of inserts, updates and deletes, with delete vectors (merge on read).

Per batch of changes: the superseded rows are located through an index from key to (file, position), their positions are set
in bitmaps per file, and the new images are appended in new files; old files are never rewritten. A read filters the
positions whose bit is set, in the task that scans the file, without a join. Tombstones are kept as images, so that an older
write that arrives later cannot revive a key.

Layout below ``root``: ``data/S`` (images), ``index/S`` (key, version, file and position of each image, in folders by a hash
of the key) and ``vectors/S/file=F`` (block, bitmap of 32,768 positions), where S is ``batch=N`` or, once batches have been
compacted, ``batch=Nc``; ``finished`` and ``compacted`` are the ledgers. A batch counts once it stands in the ledger; until then it
is applied again from the start, by this object or by another one on the same folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.session import remove, ship
from auditlake.sources.ledger import Ledger

#: Positions per bitmap: fixed by Spark's bitmap functions (4 KB).
BLOCK = 32_768
#: Folders of the index, by a hash of the key: a batch reads those of its own keys.
BUCKETS = 16
#: Data files whose vectors a task keeps at hand; it scans one after the other.
FILES_AT_HAND = 4


def living(root: str, segments: Sequence[str]) -> Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]]:
    """For file names and positions: whether no vector of the segments has the position's bit set.

    The vectors of a file are read once by the task that scans it. They lie on a file system pyarrow knows.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        held: dict[str, dict[int, np.ndarray]] = {}

        def bits(file: str) -> dict[int, np.ndarray]:
            if file not in held:
                if len(held) >= FILES_AT_HAND:
                    held.clear()
                blocks: dict[int, np.ndarray] = {}
                found = system.get_file_info([f"{base}/vectors/{s}/file={file}" for s in segments])
                for info in found:
                    if info.type != fs.FileType.Directory:
                        continue
                    for part in system.get_file_info(fs.FileSelector(info.path)):
                        if part.base_name.startswith(("_", ".")):
                            continue
                        t = pq.ParquetFile(system.open_input_file(part.path)).read(columns=["block", "bitmap"])
                        for block, raw in zip(t.column("block").to_pylist(), t.column("bitmap").to_pylist(), strict=True):
                            new = np.frombuffer(raw, np.uint8)
                            blocks[block] = blocks[block] | new if block in blocks else new
                held[file] = blocks
            return held[file]

        for files, positions in batches:
            out = np.ones(len(files), bool)
            codes, names = pd.factorize(files)
            pos = positions.to_numpy(np.int64)
            for code, name in enumerate(names):
                blocks = bits(name)
                if not blocks:
                    continue
                mine = np.flatnonzero(codes == code)
                which = pos[mine] // BLOCK
                for block in np.unique(which):
                    raw = blocks.get(int(block))
                    if raw is not None:
                        rows = mine[which == block]
                        at = pos[rows] % BLOCK
                        out[rows] = (raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
            yield pd.Series(out)

    return run


class VectorTable:
    """``key`` and ``columns`` name the table's columns, ``version`` the columns that order the changes of a key.

    Versions compare as structs, column by column; equal versions of one key count as the same change. A null key is a
    key of its own. ``deleted`` is a boolean (null: not deleted). Batches have rising numbers; one that was finished before
    is left as it is, and a lower number than the last finished one is refused.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, version: Sequence[str], columns: Sequence[str], deleted: str = "deleted", buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.version, self.columns, self.deleted, self.buckets = spark, root, key, list(version), list(columns), deleted, buckets
        self.finished, self.compacted = Ledger(spark, f"{root}/finished"), Ledger(spark, f"{root}/compacted")

    def segments(self) -> list[str]:
        """The folders that make up the table, oldest first."""
        base = self.compacted.numbers()[-1:]
        return [f"batch={n}c" for n in base] + [f"batch={n}" for n in self.finished.numbers() if not base or n > base[0]]

    def _read(self, kind: str, segments: Sequence[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{kind}/{s}" for s in (self.segments() if segments is None else segments)]
        if kind == "data":
            return self.spark.read.parquet(*paths)
        return self.spark.read.schema(self.index_schema).option("basePath", f"{self.root}/index").parquet(*paths) if kind == "index" else self.spark.read.schema("block long, bitmap binary, file string").parquet(*paths)

    def newest(self, changes: DataFrame, *by: str) -> DataFrame:
        """The newest image per key (and ``by``): ``k``, ``image`` = (version, deleted, columns). Combines on the map side."""
        image = F.struct(
            F.struct(*self.version).alias("version"), F.coalesce(F.col(self.deleted), F.lit(False)).alias("deleted"), F.struct(*self.columns).alias("row")
        )
        return changes.select(F.col(self.key).alias("k"), *by, image.alias("image")).groupBy("k", *by).agg(F.max("image").alias("image"))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _index(self, data: DataFrame, segment: str) -> None:
        rows = data.select("k", "image.version", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"), self._bucket(F.col("k")).alias("b"))
        rows.repartition("b").sortWithinPartitions("b", "k").write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/index/{segment}")

    def apply(self, number: int, changes: DataFrame, newest: bool = False) -> None:
        """Apply batch ``number``. ``newest``: the rows are already those of :meth:`newest`."""
        done = self.finished.numbers()
        if number in done:
            return
        if done and number < done[-1]:
            raise ValueError(f"batch {done[-1]} is finished; {number} comes too late")
        segments, segment = self.segments(), f"batch={number}"
        rows, place = changes if newest else self.newest(changes), "struct<file:string,pos:bigint>"
        if segments:
            # Staged, so that it is computed once and its size is known: a small batch is broadcast and the index only scanned.
            rows.select("k", "image", self._bucket(F.col("k")).alias("b")).write.mode("overwrite").parquet(f"{self.root}/staged")
            staged = self.spark.read.parquet(f"{self.root}/staged")
            self.index_schema = T.StructType([staged.schema["k"], T.StructField("version", staged.schema["image"].dataType["version"].dataType), T.StructField("file", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("b", T.IntegerType())])
            wanted = [r["b"] for r in staged.select("b").distinct().collect()]  # at most BUCKETS
            keys = staged.select(F.col("k").alias("key"))
            index = self._read("index", segments).filter(F.col("b").isin(wanted))
            held = index.join(keys, index["k"].eqNullSafe(keys["key"])).groupBy("key").agg(F.max(F.struct("version", "file", "pos")).alias("held"))
            rows = staged.join(held, staged["k"].eqNullSafe(held["key"]), "left").filter("held IS NULL OR image.version > held.version")
            rows = rows.select("k", "image", F.when(F.col("held").isNotNull(), F.struct("held.file", "held.pos")).cast(place).alias("old"))
        else:
            rows = rows.select("k", "image", F.lit(None).cast(place).alias("old"))
        rows.write.mode("overwrite").parquet(f"{self.root}/data/{segment}")
        data = self.spark.read.parquet(f"{self.root}/data/{segment}")
        self._index(data, segment)
        if segments:
            bits = data.filter("old IS NOT NULL").select("old.file", "old.pos").groupBy("file", F.expr(f"pos div {BLOCK}").alias("block"))
            vectors = bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(pos + 1))").alias("bitmap"))
            vectors.repartition("file").write.mode("overwrite").partitionBy("file").parquet(f"{self.root}/vectors/{segment}")
        if not self.finished.add(number):
            raise ValueError(f"batch {number} was finished by another writer")

    def vectors(self) -> DataFrame:
        """One bitmap per file and block of positions, over all batches (to look at; reads take them file by file)."""
        found = [s for s in self.segments()[1:]]
        rows = self._read("vectors", found) if found else self.spark.createDataFrame([], "block long, bitmap binary, file string")
        return rows.groupBy("file", "block").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))

    def _images(self, segments: Sequence[str], tombstones: bool) -> DataFrame:
        data = self._read("data", segments).select("k", "image", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__pos"))
        if not tombstones:
            data = data.filter("NOT image.deleted")
        if len(segments) > 1:
            ship(self.spark)
            alive = F.pandas_udf(living(self.root, segments[1:]), "boolean")
            data = data.filter(alive("__file", "__pos"))
        return data.select("k", "image")

    def read(self, tombstones: bool = False) -> DataFrame:
        """The current rows: ``k``, ``version``, ``deleted`` and the table's columns; deleted keys only with ``tombstones``."""
        return self._images(self.segments(), tombstones).select("k", "image.version", "image.deleted", "image.row.*")

    def compact(self) -> None:
        """Rewrite the table without its superseded rows; the folders it was made of stay until :meth:`vacuum`."""
        segments, done = self.segments(), self.finished.numbers()
        if len(segments) < 2:
            return
        segment = f"batch={done[-1]}c"
        rows = self._images(segments, True).withColumn("old", F.lit(None).cast("struct<file:string,pos:bigint>"))
        rows.write.mode("overwrite").parquet(f"{self.root}/data/{segment}")
        self._index(self.spark.read.parquet(f"{self.root}/data/{segment}"), segment)
        self.compacted.add(done[-1])

    def vacuum(self) -> None:
        """Remove the folders that compaction has made superfluous; no reader of the older table may be at work."""
        for last in self.compacted.numbers()[-1:]:
            old = [f"batch={n}" for n in self.finished.numbers() if n <= last] + [f"batch={n}c" for n in self.compacted.numbers()[:-1]]
            for kind in ("data", "index", "vectors"):
                for s in old:
                    remove(self.spark, f"{self.root}/{kind}/{s}")
