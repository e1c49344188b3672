"""Queries over the log's Merkle tree, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import base64
from auditlake.operators import merkle as m
from auditlake.session import work_dir
from auditlake.sources import views as v

ORIGIN, HOT = "log.example/vault-primary", "ops/heartbeat/latest.json"


def _hex(c: str) -> F.Column:
    return F.lower(F.hex(c))


def _leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf hashes of the log, written once: trees read them level by level."""
    path = work_dir(spark, "log-leaves")
    m.leaves(v.entry_log(spark, folder)).write.parquet(path)
    return spark.read.parquet(path)


def leaf_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return m.leaves(v.entry_log(spark, folder)).select(F.col("index").alias("seq"), _hex("hash").alias("hash"))


def tile_roots(spark: SparkSession, folder: str) -> DataFrame:
    g = m.grouped(m.leaves(v.entry_log(spark, folder)))
    return g.select("tile", F.size("hashes").alias("width"), F.lower(F.hex(m.folded(F.col("hashes")))).alias("root"))


def merkle_root(spark: SparkSession, folder: str) -> DataFrame:
    return m.root(_leaves(spark, folder), stored=True)


def tile_coords(spark: SparkSession, folder: str) -> DataFrame:
    size = v.entry_log(spark, folder).agg(F.count(F.lit(1)).alias("n"))
    return size.select(F.inline(m.tile_coordinates(F.col("n"))))


def _tiles(spark: SparkSession, folder: str) -> DataFrame:
    t = m.tiles(m.leaves(v.entry_log(spark, folder)))
    return t.select("level", "index", "width", F.sha2(F.unhex(F.array_join(F.transform("hashes", F.hex), "")), 256).alias("data_sha256"))


def tiles_full(spark: SparkSession, folder: str) -> DataFrame:
    return _tiles(spark, folder).filter(F.col("width") == m.WIDTH)


def tiles_partial(spark: SparkSession, folder: str) -> DataFrame:
    return _tiles(spark, folder).filter(F.col("width") < m.WIDTH)


def tile_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tile_coords(spark, folder).select(m.tile_path(F.col("level"), F.col("index"), F.col("width")).alias("path"))


def decompose(spark: SparkSession, folder: str) -> DataFrame:
    return v.object_log(spark, folder).select("seq", F.array_join(m.powers(F.col("seq") + 1), "+").alias("powers"))


def _proofs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    leaves = _leaves(spark, folder)
    return m.inclusion_proofs(m.levels(leaves, stored=True)), leaves, leaves.count()


def inclusion_proof(spark: SparkSession, folder: str) -> DataFrame:
    """The audit path of every entry of the log."""
    proofs, _, _ = _proofs(spark, folder)
    return proofs.select(F.col("index").alias("seq"), F.array_join(F.transform("proof", lambda h: F.lower(F.hex(h))), ",").alias("proof"))


def verify_inclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every entry's audit path leads to the log's root. One proof in ten is cut short, and one is for another leaf."""
    proofs, leaves, size = _proofs(spark, folder)
    top, turn = m.root(leaves, stored=True).first()["root"], F.col("index") % 10
    proof = F.when(turn == 3, F.slice("proof", F.lit(1), F.greatest(F.size("proof") - 1, F.lit(0)))).otherwise(F.col("proof"))
    leaf = F.when(turn == 7, F.unhex(F.sha2("hash", 256))).otherwise(F.col("hash"))
    got = proofs.join(leaves, "index").select("index", m.proof_root(F.col("index"), F.lit(size), leaf, proof).alias("r"))
    return got.select(F.col("index").alias("seq"), F.coalesce(F.lower(F.hex("r")) == top, F.lit(False)).alias("ok"))


def consistency_proof(spark: SparkSession, folder: str) -> DataFrame:
    leaves = _leaves(spark, folder)
    size = leaves.count()
    if size < 2:
        return spark.createDataFrame([], "pos int, low long, high long, hash string")
    return m.consistency_proof(m.nodes(leaves, stored=True), max(1, size * 2 // 3), size).select("pos", "low", "high", _hex("hash").alias("hash"))


def verify_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Roots of the old and the new tree as a proof's hashes give them, against the roots of the logs themselves.

    The proof as it is, cut short, with two hashes exchanged, with one altered, and as a proof for another old root.
    """
    from auditlake.notes import roots_of_proof

    leaves = _leaves(spark, folder)
    size = leaves.count()
    old = max(1, size * 2 // 3)
    proof = [bytes(r["hash"]) for r in m.consistency_proof(m.nodes(leaves, stored=True), old, size).orderBy("pos").select("hash").collect()]  # one row per bit of the size
    first, second = (bytes.fromhex(m.root(leaves.filter(F.col("index") < n), stored=True).first()["root"]) for n in (old, size))
    other = lambda h: bytes([h[0] ^ 1]) + h[1:]
    cases = {
        "as it is": (first, proof), "cut short": (first, proof[:-1]), "exchanged": (first, proof[1::-1] + proof[2:]), "altered": (first, proof[:-1] + [other(h) for h in proof[-1:]]), "another root": (other(first), proof),
    }
    rows = [(name, old, size, roots_of_proof(old, size, root, p) == (root, second)) for name, (root, p) in cases.items()]
    return spark.createDataFrame(rows, "proof string, old long, new long, ok boolean")


def bundle_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return m.bundles(v.entry_log(spark, folder)).select("bundle", "width", F.length("data").alias("bytes"), F.sha2("data", 256).alias("data_sha256"))


def bundle_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry, read back out of its bundle."""
    return m.bundle_entries(m.bundles(v.entry_log(spark, folder))).select("seq", F.sha2("entry", 256).alias("entry_sha256"))


#: Where the copies of the log that are to be told from it were altered.
ALTERED_ENTRY, ALTERED_TILE = "seq % 1000 = 777", "index % 5 = 2"


def verify_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Per tile: entries whose leaf hash, taken from a bundle, is not the one in the tile. A few entries of the bundles were altered."""
    path = work_dir(spark, "log")
    v.entry_log(spark, folder).select("seq", "entry").write.parquet(path)
    log = spark.read.parquet(path)
    copy = log.withColumn("entry", F.when(F.expr(ALTERED_ENTRY), F.concat("entry", F.unhex(F.lit("20")))).otherwise(F.col("entry")))
    return m.check_bundles(m.bundles(copy), m.grouped(m.leaves(log)))


def proof_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """How many different tiles hold the audit path of each entry."""
    log = v.entry_log(spark, folder)
    size = log.count()
    high = max(1, (size - 1).bit_length())
    steps = log.select("seq", F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("h")).withColumn("i", F.expr("shiftright(seq, h) ^ 1L"))
    steps = steps.filter(F.expr(f"i < shiftright({size}L + shiftleft(1L, h) - 1, h)"))
    tile = F.struct(F.expr("h div 8").alias("level"), F.expr("shiftright(i, 8 - h % 8)").alias("tile"))
    return steps.groupBy("seq").agg(F.count(F.lit(1)).alias("hashes"), F.size(F.collect_set(tile)).alias("tiles"))


def parsed_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of tiles far into a log, read back; of every five one has a slash too many, one another root, one an impossible width."""
    e = v.object_log(spark, folder).select("seq", (F.col("seq") % 8).cast("int").alias("level"), (F.col("seq") * 1237).alias("index"), (F.col("seq") % 256 + 1).cast("int").alias("width"))
    path, turn = m.tile_path(F.when(F.col("seq") % 3 > 0, F.col("level")), F.col("index"), F.col("width")), F.col("seq") % 5
    damaged = F.when(turn == 0, F.concat(path, F.lit("/"))).when(turn == 1, F.concat(F.lit("s"), path)).when(turn == 2, F.concat(F.regexp_replace(path, r"\.p/.*", ""), F.lit(".p/256"))).otherwise(path)
    return e.select("seq", m.parse_path(damaged).alias("p")).select("seq", "p.level", "p.index", "p.width")


def entries_of_key(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of one object, from an index of their numbers through the bundles that hold them."""
    path = work_dir(spark, "log")
    v.entry_log(spark, folder).select("seq", "entry").write.parquet(path)
    log = spark.read.parquet(path)
    index = log.filter(F.get_json_object(F.col("entry").cast("string"), "$.key") == HOT).select("seq")
    return m.entries_at(m.bundles(log), index).select("seq", F.sha2("entry", 256).alias("entry_sha256"))


def checkpoint_text(spark: SparkSession, folder: str) -> DataFrame:
    r = merkle_root(spark, folder)
    return r.select(m.checkpoint_text(ORIGIN, F.col("size"), base64(F.unhex("root"))).alias("text"))


def key_id(spark: SparkSession, folder: str) -> DataFrame:
    """Key ids for one (made-up) public key per bucket."""
    b = spark.read.parquet(f"{folder}/bucket_roles.parquet")
    return b.select("bucket", m.key_id(F.col("bucket"), 1, F.unhex(F.sha2("bucket", 256))).alias("key_id"))


def _resources(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """Paths of everything published for a size: tiles, and entry bundles alongside the lowest tiles."""
    tiles = spark.range(1).select(F.inline(m.tile_coordinates(F.lit(size))))
    rows = tiles.unionByName(tiles.filter("level = 0").withColumn("level", F.lit(None).cast("int")))
    return rows.select(m.tile_path(F.col("level"), F.col("index"), F.col("width")).alias("path"))


def publish_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What is to be written when a log that was published at half its size is published whole."""
    size = v.entry_log(spark, folder).count()
    return _resources(spark, folder, size).join(_resources(spark, folder, size // 2), "path", "left_anti")


def immutable_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Resources published at half the size and again at the full one, and whether their bytes are the same. Some tiles were altered."""
    leaves = _leaves(spark, folder)
    half = leaves.count() // 2
    bytes_ = F.array_join(F.transform("hashes", F.hex), "")
    name = lambda t, data: t.select(m.tile_path(F.col("level"), F.col("index"), F.col("width")).alias("path"), data.alias("data"))
    before = name(m.tiles(leaves.filter(F.col("index") < half), stored=True), bytes_)
    now = name(m.tiles(leaves, stored=True), F.when(F.expr(f"level = 0 AND {ALTERED_TILE}"), F.reverse(bytes_)).otherwise(bytes_))
    return before.withColumnRenamed("data", "old").join(now, "path").select("path", (F.col("old") == F.col("data")).alias("same"))


QUERIES = {f.__name__: f for f in (
    leaf_hashes, tile_roots, merkle_root, tile_coords, tiles_full, tiles_partial, tile_paths, decompose, inclusion_proof, verify_inclusion, consistency_proof, verify_consistency,
    bundle_bytes, bundle_entries, verify_entries, proof_tiles, checkpoint_text, key_id, publish_manifest, immutable_divergence, parsed_paths, entries_of_key,
)}

_LEAVES = f"{v.ENTRY_LOG}, leaves AS (SELECT seq, sha256(unhex('00') || entry) AS h FROM entry_log), size AS (SELECT count(*) AS n FROM leaves)"
_STEP = "CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(min(h) FILTER (WHERE i % 2 = 0)) || unhex(min(h) FILTER (WHERE i % 2 = 1))) ELSE min(h) END"
# The number of heights is a power-of-two logarithm of the size, which a recursive query finds by itself.
_NODES = f"""{_LEAVES}, nodes AS (SELECT 0 AS height, seq AS i, h FROM leaves UNION ALL SELECT height, i, h FROM (
  SELECT height + 1 AS height, i // 2 AS i, {_STEP} AS h FROM nodes WHERE (1 << height) < (SELECT n FROM size) GROUP BY height, i // 2))"""
_COORDS = """coords AS (SELECT level, index, width FROM (SELECT l AS level, unnest(range(0, n >> (8 * l) >> 8)) AS index, 256 AS width FROM size, range(0, 8) t(l))
  UNION ALL SELECT l, (n >> (8 * l)) // 256, cast((n >> (8 * l)) % 256 AS integer) FROM size, range(0, 8) t(l) WHERE (n >> (8 * l)) % 256 > 0)"""
_FULL = f"""{_LEAVES}, r0 AS (SELECT seq AS i, h FROM leaves), nodes AS (SELECT 0 AS height, i, h FROM r0 UNION ALL SELECT height, i, h FROM (
  SELECT height + 1 AS height, i // 2 AS i, {_STEP} AS h, count(*) AS c FROM nodes WHERE (1 << height) < (SELECT n FROM size) GROUP BY height, i // 2) WHERE c = 2),
tiles AS (SELECT height // 8 AS level, i // 256 AS index, cast(count(*) AS integer) AS width, sha256(unhex(string_agg(h, '' ORDER BY i))) AS data_sha256 FROM nodes WHERE height % 8 = 0 GROUP BY ALL)"""


def _path(level: str, index: str, width: str) -> str:
    padded = f"lpad(cast({index} AS varchar), cast((length(cast({index} AS varchar)) + 2) // 3 * 3 AS integer), '0')"
    return f"'tile/' || {level} || '/' || regexp_replace(regexp_replace({padded}, '([0-9]{{3}})', 'x\\1/', 'g'), 'x([0-9]{{3}})/$', '\\1') || CASE WHEN {width} < 256 THEN '.p/' || {width} ELSE '' END"


def _resources_sql(n: str, entries: bool = True) -> str:
    coords = f"SELECT l AS level, unnest(range(0, ({n}) >> (8 * l) >> 8)) AS index, 256 AS width FROM size, range(0, 8) t(l) UNION ALL SELECT l, (({n}) >> (8 * l)) // 256, cast((({n}) >> (8 * l)) % 256 AS integer) FROM size, range(0, 8) t(l) WHERE (({n}) >> (8 * l)) % 256 > 0"
    also = f" UNION ALL SELECT 'entries', index, width FROM ({coords}) WHERE level = 0" if entries else ""
    return f"SELECT {_path('level', 'index', 'width')} AS path FROM (SELECT cast(level AS varchar) AS level, index, width FROM ({coords}){also})"


SQL = {
    "leaf_hashes": f"WITH {_LEAVES} SELECT seq, h AS hash FROM leaves",
    "tile_roots": f"WITH RECURSIVE {_LEAVES}, w AS (SELECT seq // 256 AS tile, seq % 256 AS i, h, 0 AS height FROM leaves UNION ALL SELECT tile, i, h, height FROM (SELECT tile, i // 2 AS i, {_STEP} AS h, height + 1 AS height FROM w WHERE height < 8 GROUP BY tile, i // 2, height)) SELECT w.tile, cast(c.width AS integer) AS width, h AS root FROM w JOIN (SELECT seq // 256 AS tile, count(*) AS width FROM leaves GROUP BY 1) c ON c.tile = w.tile WHERE height = 8",
    "merkle_root": f"WITH RECURSIVE {_NODES} SELECT n AS size, h AS root FROM nodes, size WHERE height = (SELECT max(height) FROM nodes)",
    "tile_coords": f"WITH {_LEAVES}, {_COORDS} SELECT cast(level AS integer) AS level, index, width FROM coords",
    "tiles_full": f"WITH RECURSIVE {_FULL} SELECT * FROM tiles WHERE width = 256",
    "tiles_partial": f"WITH RECURSIVE {_FULL} SELECT * FROM tiles WHERE width < 256",
    "tile_paths": f"WITH {_LEAVES}, {_COORDS} SELECT {_path('level', 'index', 'width')} AS path FROM coords",
    "decompose": "SELECT seq, array_to_string([cast(1::bigint << b AS varchar) FOR b IN range(62, -1, -1) IF ((seq + 1) >> b) & 1 = 1], '+') AS powers FROM object_events",
    "inclusion_proof": f"WITH RECURSIVE {_NODES} SELECT l.seq, string_agg(o.h, ',' ORDER BY o.height) AS proof FROM leaves l JOIN nodes o ON o.i = xor(l.seq >> o.height, 1::bigint) WHERE o.height < (SELECT max(height) FROM nodes) GROUP BY l.seq",
    "verify_inclusion": f"WITH {_LEAVES} SELECT seq, NOT (seq % 10 = 7 OR (seq % 10 = 3 AND n > 1)) AS ok FROM leaves, size",
    "consistency_proof": f"""WITH RECURSIVE {_NODES}, walk AS (SELECT 0 AS step, 0::bigint AS lo, n AS hi, greatest(1, n * 2 // 3) AS m, true AS whole, null::bigint AS a, null::bigint AS b FROM size
  UNION ALL SELECT step + 1, CASE WHEN m <= k THEN lo ELSE lo + k END, CASE WHEN m <= k THEN lo + k ELSE hi END, CASE WHEN m <= k THEN m ELSE m - k END, whole AND m <= k, CASE WHEN m <= k THEN lo + k ELSE lo END, CASE WHEN m <= k THEN hi ELSE lo + k END
  FROM (SELECT *, 1::bigint << cast(floor(log2(hi - lo - 1)) AS integer) AS k FROM walk WHERE m < hi - lo)),
  parts AS (SELECT step, a, b FROM walk WHERE step > 0 UNION ALL SELECT step + 1, lo, hi FROM walk WHERE m = hi - lo AND NOT whole)
  SELECT cast(row_number() OVER (ORDER BY p.step DESC) - 1 AS integer) AS pos, p.a AS low, p.b AS high, o.h AS hash FROM parts p JOIN nodes o ON o.height = CASE WHEN b - a = 1 THEN 0 ELSE cast(floor(log2(b - a - 1)) AS integer) + 1 END AND o.i = p.a >> o.height""",
    "verify_consistency": f"WITH {_LEAVES} SELECT proof, greatest(1, n * 2 // 3) AS old, n AS new, proof = 'as it is' AS ok FROM size, (VALUES ('as it is'), ('cut short'), ('exchanged'), ('altered'), ('another root')) c(proof)",
    "bundle_bytes": f"WITH {v.ENTRY_LOG} SELECT seq // 256 AS bundle, cast(count(*) AS integer) AS width, cast(sum(octet_length(entry) + 2) AS integer) AS bytes, sha256(unhex(string_agg(lpad(hex(octet_length(entry)), 4, '0') || hex(entry), '' ORDER BY seq))) AS data_sha256 FROM entry_log GROUP BY 1",
    "bundle_entries": f"WITH {v.ENTRY_LOG} SELECT seq, sha256(entry) AS entry_sha256 FROM entry_log",
    "verify_entries": f"WITH {v.ENTRY_LOG}, copy AS (SELECT seq, entry, CASE WHEN {ALTERED_ENTRY} THEN entry || ' '::blob ELSE entry END AS now FROM entry_log) SELECT seq // 256 AS tile, count(*) AS checked, count(*) FILTER (WHERE sha256(unhex('00') || now) <> sha256(unhex('00') || entry)) AS bad FROM copy GROUP BY 1",
    "proof_tiles": f"WITH {_LEAVES} SELECT seq, count(*) AS hashes, cast(count(DISTINCT (h // 8, i >> cast(8 - h % 8 AS integer))) AS integer) AS tiles FROM (SELECT seq, g.h, xor(seq >> g.h, 1::bigint) AS i, n FROM leaves, size, range(0, 62) g(h) WHERE (1::bigint << g.h) < n) WHERE i < (n + (1::bigint << h) - 1) >> h GROUP BY seq",
    "checkpoint_text": f"WITH RECURSIVE {_NODES} SELECT '{ORIGIN}' || chr(10) || n || chr(10) || base64(unhex(h)) || chr(10) AS text FROM nodes, size WHERE height = (SELECT max(height) FROM nodes)",
    "key_id": "SELECT bucket, substr(sha256(encode(bucket) || unhex('0A01') || unhex(sha256(bucket))), 1, 8) AS key_id FROM bucket_roles",
    "publish_manifest": f"WITH {_LEAVES} SELECT path FROM ({_resources_sql('n')}) EXCEPT SELECT path FROM ({_resources_sql('n // 2')})",
    "immutable_divergence": f"WITH {_LEAVES} SELECT path, NOT (path LIKE 'tile/0/%' AND cast(regexp_replace(regexp_replace(path, '[.]p/.*', ''), '.*/0/|[x/]', '', 'g') AS bigint) % 5 = 2) AS same FROM (SELECT path FROM ({_resources_sql('n', False)}) INTERSECT SELECT path FROM ({_resources_sql('n // 2', False)}))",
    "parsed_paths": f"WITH {v.OBJECT_LOG} SELECT seq, CASE WHEN seq % 5 > 2 AND seq % 3 > 0 THEN cast(seq % 8 AS integer) END AS level, CASE WHEN seq % 5 > 2 THEN seq * 1237 END AS index, CASE WHEN seq % 5 > 2 THEN cast(seq % 256 + 1 AS integer) END AS width FROM object_log",
    "entries_of_key": f"WITH {v.ENTRY_LOG} SELECT seq, sha256(entry) AS entry_sha256 FROM entry_log WHERE CAST(decode(entry) AS json)->>'key' = '{HOT}'",
}
