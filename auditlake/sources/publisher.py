"""Publishing a log: immutable resources first, the live checkpoint last.

``root/resources/F`` holds what a publication added (``path``, ``data``), ``root/edges/F`` the right edge of the tree after it,
``root/archive`` the signed checkpoint of each size, ``root/steps`` the ledger of publications, ``root/live`` one row, the newest
checkpoint. Every publication writes folders of its own and counts once it stands in the ledger, which takes one successor per
step: of two publishers that start from the same step one wins. One that is cut short is simply run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import notes
from auditlake.errors import LogDiverged, NotVerifiable
from auditlake.operators import merkle as m
from auditlake.sources.ledger import Ledger


class Publisher:
    def __init__(self, spark: SparkSession, root: str, key: notes.Key) -> None:
        self.spark, self.root, self.key = spark, root, key
        self.steps = Ledger(spark, f"{root}/steps")

    def _step(self, number: int) -> dict:
        return json.loads(self.steps.note(number))

    def live(self) -> notes.Checkpoint | None:
        """The newest checkpoint; what ``root/live`` shows, or will once a publication that was cut short is run again."""
        done = self.steps.numbers()
        return notes.open_checkpoint(self._step(done[-1])["note"], self.key) if done else None

    def stored(self) -> DataFrame | None:
        """``path``, ``data`` of everything published."""
        folders = [step["folder"] for n in self.steps.numbers() if (step := self._step(n))["folder"]]
        return self.spark.read.parquet(*[f"{self.root}/resources/{f}" for f in folders]) if folders else None

    def _edges(self, folder: str) -> dict[int, list[bytes]]:
        return {r["level"]: [bytes(h) for h in r["hashes"]] for r in self.spark.read.parquet(f"{self.root}/edges/{folder}").collect()}  # at most eight rows

    def publish(self, log: DataFrame, size: int) -> notes.Checkpoint:
        """Publish the first ``size`` entries of ``log`` (``seq``, ``entry``); never fewer than are published already.

        Only the entries from the last full bundle on are read: the cost does not depend on the length of the log. Raises
        :class:`LogDiverged`, before anything counts, if the entries of the last, partial bundle are not those published, the log
        has gaps or ends before ``size``, an archived checkpoint of that size has another root, or another publisher was faster.
        """
        done = self.steps.numbers()
        last = self._step(done[-1]) if done else None
        before = notes.open_checkpoint(last["note"], self.key) if last else notes.Checkpoint(self.key.name, 0, bytes.fromhex(m.EMPTY_ROOT))
        old, edges = before.size, self._edges(last["edges"]) if last else {}
        if size < old:
            raise LogDiverged(f"{old} entries are published, {size} would be a step back")
        start = old - old % m.WIDTH
        part = log.filter(F.col("seq").between(start, size - 1))
        got = part.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d")).first()
        if (got["n"], got["d"]) != (size - start, size - start):
            raise LogDiverged(f"the log has {got['n']} entries from {start} to {size}, of {got['d']} numbers")
        leaves = m.leaves(part)
        again = [bytes(r["hash"]) for r in leaves.filter(F.col("index") < old).orderBy("index").collect()]  # fewer than a bundle
        if again != edges.get(0, []):
            raise LogDiverged("a published resource would change")
        if last and size == old:
            return before
        name, new_edges = f"{len(done)}-{uuid.uuid4().hex}", edges
        if size > old:
            tiles, new_edges = m.grown(leaves.filter(F.col("index") >= old), old, size, edges)
            tiles = tiles.select(m.tile_path(F.col("level"), F.col("index"), F.col("width")).alias("path"), F.unhex(F.array_join(F.transform("hashes", F.hex), "")).alias("data"))
            bundles = m.bundles(part).select(m.tile_path(F.lit(None), F.col("bundle"), F.col("width")).alias("path"), "data")
            tiles.unionByName(bundles).write.parquet(f"{self.root}/resources/{name}")
        rows = [(level, [bytearray(h) for h in hashes]) for level, hashes in new_edges.items()]
        self.spark.createDataFrame(rows, "level int, hashes array<binary>").coalesce(1).write.parquet(f"{self.root}/edges/{name}")
        point = notes.Checkpoint(self.key.name, size, m.edge_root(size, new_edges))
        note = notes.sign_note(point.text, self.key)
        kept = Ledger(self.spark, f"{self.root}/archive")
        if not kept.add(size, note) and notes.open_checkpoint(kept.note(size), self.key) != point:
            raise LogDiverged("an archived checkpoint has another root")
        if not self.steps.add(len(done), json.dumps({"folder": name if size > old else None, "edges": name, "note": note})):
            raise LogDiverged("another publisher was faster")
        self.spark.createDataFrame([(note,)], "note string").write.mode("overwrite").parquet(f"{self.root}/live")  # last
        return point

    def audit(self, log: DataFrame) -> None:
        """Compare all of the log with what is published, in one pass: raises :class:`LogDiverged` at the first difference."""
        point, stored = self.live(), self.stored()
        if point is None or stored is None:
            raise NotVerifiable("nothing is published")
        g = m.grouped(m.leaves(log.filter(F.col("seq") < point.size)))
        now = g.select(m.tile_path(F.lit(0), F.col("tile"), F.size("hashes")).alias("path"), F.unhex(F.array_join(F.transform("hashes", F.hex), "")).alias("now"))
        if now.count() != -(-point.size // m.WIDTH) or now.join(stored, "path", "left").filter("data IS NULL OR data <> now").limit(1).count():
            raise LogDiverged("the log is not the published one")

    def verify(self) -> notes.Checkpoint:
        """Read everything back: entries of the bundles against the lowest tiles, and the tree against the live checkpoint."""
        point, stored = self.live(), self.stored()
        if point is None or stored is None:
            raise NotVerifiable("nothing is published")
        size = point.size
        want = self.spark.range(1).select(F.inline(m.tile_coordinates(F.lit(size)))).filter("level = 0")
        named = want.select("index", "width", m.tile_path(F.lit(None), F.col("index"), F.col("width")).alias("path"))
        bundles = named.join(stored, "path").select(F.col("index").alias("bundle"), "width", "data")
        if bundles.count() != -(-size // m.WIDTH):
            raise NotVerifiable("an entry bundle is missing")
        leaves = m.leaves(m.bundle_entries(bundles))
        tiles = want.select(m.tile_path(F.lit(0), F.col("index"), F.col("width")).alias("path")).join(stored, "path")
        again = m.grouped(leaves).select(m.tile_path(F.lit(0), F.col("tile"), F.size("hashes")).alias("path"), F.unhex(F.array_join(F.transform("hashes", F.hex), "")).alias("read"))
        if again.join(tiles, "path", "left").filter("data IS NULL OR data <> read").limit(1).count():
            raise LogDiverged("entries do not fit their tile")
        if bytes.fromhex(m.root(leaves).first()["root"]) != point.root:
            raise LogDiverged("the entries do not lead to the checkpoint's root")
        return point
