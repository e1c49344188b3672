"""RFC 6962 Merkle trees over a log, as DataFrames: hashes, tiles, roots, proofs and their checks.

Hashes are grouped 256 at a time (one shuffle per level, each 256 times smaller than the one before) and folded inside the
group with built-in higher-order functions. Pairing neighbours level by level and carrying an unpaired last node up
unchanged gives a tree with exactly the RFC's root, whose siblings are exactly the RFC's audit paths, so that roots and
proofs need no special cases for sizes that are no power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.notes import pair
from auditlake.session import work_dir

WIDTH, HEIGHT = 256, 8
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def leaf_hash(entry: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), entry), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


def _pairs(hashes: Column) -> Column:
    """The next height of an array of nodes; an unpaired last node is carried up."""
    n = F.size(hashes)
    at = lambda i: F.element_at(hashes, (i + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.floor((n + 1) / 2).cast("int") - 1), lambda i: F.when(2 * i + 1 < n, node_hash(at(2 * i), at(2 * i + 1))).otherwise(at(2 * i)))


def folded(hashes: Column) -> Column:
    """The root of up to 256 hashes."""
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), hashes, lambda acc, _: _pairs(acc)), 1)


def _heights(hashes: Column) -> Column:
    """All heights 0..8 of up to 256 hashes, as an array of arrays."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(hashes), lambda acc, _: F.concat(acc, F.array(_pairs(F.element_at(acc, -1)))))


def grouped(hashes: DataFrame) -> DataFrame:
    """``tile``, ``hashes`` (at most 256, in order) of rows ``index``, ``hash``."""
    rows = hashes.groupBy(F.expr(f"index div {WIDTH}").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("h"))
    return rows.select("tile", F.transform("h", lambda x: x["hash"]).alias("hashes"))


def leaves(log: DataFrame, seq: str = "seq", entry: str = "entry") -> DataFrame:
    return log.select(F.col(seq).alias("index"), leaf_hash(F.col(entry)).alias("hash"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def levels(hashes: DataFrame, stored: bool = False, cut: bool = True) -> list[DataFrame]:
    """The groups of every level, from the leaves up to the single group that holds the root. Empty for an empty log.

    The hashes are written once, unless they are ``stored`` already, and so is the far smaller input of each further
    level, so no level is computed twice. Without ``cut`` the levels are one chain of shuffles, for callers that read
    only the last.
    """
    hashes = hashes if stored else _written(hashes, "leaves")
    n, out = hashes.count(), []
    while n:
        out.append(grouped(hashes))
        if n <= WIDTH:
            break
        above = out[-1].select(F.col("tile").alias("index"), folded(F.col("hashes")).alias("hash"))
        hashes = _written(above, "level") if cut else above
        n = -(-n // WIDTH)
    return out


def root(hashes: DataFrame, stored: bool = False) -> DataFrame:
    """One row: ``size`` and ``root`` (hex)."""
    hashes = hashes if stored else _written(hashes, "leaves")
    size, top = hashes.count(), levels(hashes, stored=True, cut=False)
    if not top:
        return hashes.sparkSession.createDataFrame([(0, EMPTY_ROOT)], "size long, root string")
    return top[-1].select(F.lit(size).cast("long").alias("size"), F.lower(F.hex(folded(F.col("hashes")))).alias("root"))


def nodes(hashes: DataFrame, stored: bool = False) -> DataFrame:
    """All nodes of the tree: ``height``, ``index``, ``hash``. Carried nodes appear at every height they pass."""
    parts = []
    every = levels(hashes, stored)
    for level, groups in enumerate(every):
        rows = groups.select("tile", F.posexplode(_heights(F.col("hashes"))).alias("h", "row"))
        rows = rows.filter(F.col("h") < HEIGHT) if level < len(every) - 1 else rows  # the root of a group is the next level's leaf
        rows = rows.select((F.col("h") + HEIGHT * level).alias("height"), "tile", "h", F.posexplode("row").alias("i", "hash"))
        parts.append(rows.select("height", (F.col("tile") * F.expr(f"shiftright({WIDTH}, h)") + F.col("i")).alias("index"), "hash"))
    out = parts[0] if parts else hashes.sparkSession.createDataFrame([], "height int, index long, hash binary")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _siblings(hashes: Column) -> Column:
    """For each of up to 256 hashes, its siblings inside the group, lowest first; a node that is carried up has none at that height.

    The heights are bound to a lambda's variable, so that they are computed once for the group and not once for each sibling.
    """
    at = lambda every, i, h: F.get(F.get(every, h), F.call_function("shiftright", i, h).bitwiseXOR(F.lit(1)))
    one = lambda every, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda h: at(every, i, h)), lambda x: x.isNotNull())
    own = F.sequence(F.lit(0), F.size(hashes) - 1)
    return F.get(F.transform(F.array(_heights(hashes)), lambda every: F.transform(own, lambda i: one(every, i))), F.lit(0))


def inclusion_proofs(groups: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """``index``, ``proof`` (array of hashes, lowest first) of the leaves, or of those of ``wanted`` (``index``).

    ``groups``: the :func:`levels` of the tree. The lower eight siblings of a leaf lie in its own group; the rest of its path is
    that of the group in the level above, joined once per group. Nothing is shuffled but one row per 256 leaves.
    """
    upper = None
    for level in range(len(groups) - 1, -1, -1):
        g = groups[level]
        if wanted is not None and not level:
            g = g.join(wanted.select(F.expr(f"index div {WIDTH}").alias("tile")).distinct(), "tile", "left_semi")
        g = g.select("tile", _siblings(F.col("hashes")).alias("low"))
        above = F.array().cast("array<binary>")
        if upper is not None:
            g, above = g.join(upper.select(F.col("index").alias("tile"), F.col("proof").alias("above")), "tile"), F.col("above")
        rows = g.select("tile", above.alias("above"), F.posexplode("low").alias("i", "low"))
        upper = rows.select((F.col("tile") * WIDTH + F.col("i")).alias("index"), F.concat("low", "above").alias("proof"))
    return upper if wanted is None else upper.join(wanted.select("index"), "index")


def proof_root(index: Column, size: Column, leaf: Column, proof: Column) -> Column:
    """The root a proof leads to (RFC 9162, 2.1.3.2); null if the proof is too long or too short.

    The state is (fn, sn, hash): the leaf's and the last leaf's index, shifted up as siblings are consumed.
    """
    start = F.struct(index.cast("long").alias("fn"), (size - 1).cast("long").alias("sn"), leaf.alias("r"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        fn, sn, r = acc["fn"], acc["sn"], acc["r"]
        odd, last = F.pmod(fn, F.lit(2)) == 1, fn == sn
        # On the right edge, heights without a sibling are skipped: as many as fn has trailing zeros.
        zeros = F.when(odd | (fn == 0), F.lit(0)).otherwise(F.bit_count(fn.bitwiseAND(-fn) - 1)).cast("int")
        skip = F.when(last & ~odd, zeros).otherwise(F.lit(0))
        shift = lambda c: F.call_function("shiftright", c, skip + 1)
        return F.struct(shift(fn).alias("fn"), shift(sn).alias("sn"), F.when(odd | last, node_hash(p, r)).otherwise(node_hash(r, p)).alias("r"), (acc["ok"] & (sn > 0)).alias("ok"))

    end = F.aggregate(proof, start, step)
    return F.when((end["sn"] == 0) & end["ok"], end["r"])


def consistency_ranges(old: int, new: int) -> list[tuple[int, int]]:
    """The leaf ranges whose hashes prove that the tree of ``new`` leaves extends that of ``old`` (RFC 6962, 2.1.2), in order.

    Read off the bits of the last old leaf's index in the tree with carried nodes. Heights at which it is a right child all
    the way from the leaf form one subtree that is wholly old: it comes first, unless it is the whole old tree. From there up,
    the sibling at every height belongs to the proof, if there is one.
    """
    if not 0 < old <= new:
        raise ValueError("the old tree has at least one leaf and is no larger than the new one")
    if old == new:
        return []
    last, base = old - 1, (old & -old).bit_length() - 1
    nodes = [] if old == 1 << base else [(base, last >> base)]
    nodes += [(h, (last >> h) ^ 1) for h in range(base, (new - 1).bit_length()) if ((last >> h) ^ 1) << h < new]
    return [(i << h, min(new, (i + 1) << h)) for h, i in nodes]


def consistency_proof(tree: DataFrame, old: int, new: int) -> DataFrame:
    """``pos``, ``low``, ``high``, ``hash`` of the proof's nodes, in order (at most 2 log n rows)."""
    rows = [(i, lo, hi, (hi - lo - 1).bit_length()) for i, (lo, hi) in enumerate(consistency_ranges(old, new))]
    want = tree.sparkSession.createDataFrame([(i, lo, hi, h, lo >> h) for i, lo, hi, h in rows], "pos int, low long, high long, height int, index long")
    return tree.join(F.broadcast(want), ["height", "index"]).select("pos", "low", "high", "hash")  # one row per bit of the size


def tiles(log_hashes: DataFrame, stored: bool = False) -> DataFrame:
    """``level``, ``index``, ``width``, ``hashes``: the published tiles. Only full tiles feed the next level."""
    hashes, level, out = log_hashes if stored else _written(log_hashes, "tiles"), 0, None
    n = hashes.count()
    while n:
        g = grouped(hashes)
        rows = g.select(F.lit(level).alias("level"), F.col("tile").alias("index"), F.size("hashes").alias("width"), "hashes")
        out = rows if out is None else out.unionByName(rows)
        n, level = n // WIDTH, level + 1
        if n:
            hashes = _written(g.filter(F.size("hashes") == WIDTH).select(F.col("tile").alias("index"), folded(F.col("hashes")).alias("hash")), "tiles")
    return out if out is not None else log_hashes.sparkSession.createDataFrame([], "level int, index long, width int, hashes array<binary>")


def grown(entries: DataFrame, old: int, size: int, edges: dict[int, list[bytes]]) -> tuple[DataFrame, dict[int, list[bytes]]]:
    """What growing a tree from ``old`` to ``size`` leaves adds: the new tiles, as :func:`tiles` gives them, and the new right edge.

    ``entries``: ``index``, ``hash`` of the leaves from ``old`` on. ``edges``: per level the hashes of the tile that is not full. The
    cost follows the number of new leaves; the edge is at most 255 hashes for each of eight levels.
    """
    spark, level, out, right, rows = entries.sparkSession, 0, None, {}, entries
    while size >> (8 * level):
        before, now = old >> (8 * level), size >> (8 * level)
        if before == now:  # nothing new from here on up
            right.update({k: v for k, v in edges.items() if k >= level})
            break
        held = spark.createDataFrame([(before - before % WIDTH + i, bytearray(h)) for i, h in enumerate(edges.get(level, []))], "index long, hash binary")
        g = _written(grouped(rows.unionByName(held)), "grown")
        part = g.select(F.lit(level).alias("level"), F.col("tile").alias("index"), F.size("hashes").alias("width"), "hashes")
        out = part if out is None else out.unionByName(part)
        right[level] = [bytes(h) for r in g.filter(F.size("hashes") < WIDTH).select("hashes").collect() for h in r["hashes"]]  # one tile at most
        rows = g.filter(F.size("hashes") == WIDTH).select(F.col("tile").alias("index"), folded(F.col("hashes")).alias("hash"))
        level += 1
    return out, {k: v for k, v in right.items() if v}


def edge_root(size: int, edges: dict[int, list[bytes]]) -> bytes:
    """The root of a tree by its right edge: what is left over at a level is carried into the next."""
    if not size:
        return bytes.fromhex(EMPTY_ROOT)
    carried: list[bytes] = []
    for level in range((size.bit_length() + 7) // 8):
        row = edges.get(level, []) + carried
        while len(row) > 1:
            row = [pair(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        carried = row
    return carried[0]


def tile_coordinates(size: Column) -> Column:
    """Array of (level, index, width) of the tiles of a tree: per level the full ones and the partial one."""
    shape = "array<struct<level:int,index:bigint,width:int>>"
    levels_ = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda lv: F.struct(lv.alias("level"), F.call_function("shiftright", size.cast("long"), (lv * 8).cast("int")).alias("n")))
    used = F.filter(levels_, lambda x: x["n"] > 0)
    full = lambda x: F.when(x["n"] >= WIDTH, F.transform(F.sequence(F.lit(0).cast("long"), F.floor(x["n"] / WIDTH) - 1), lambda i: F.struct(x["level"].alias("level"), i.alias("index"), F.lit(WIDTH).alias("width")))).otherwise(F.array().cast(shape))
    part = lambda x: F.when(x["n"] % WIDTH > 0, F.array(F.struct(x["level"].alias("level"), F.floor(x["n"] / WIDTH).alias("index"), (x["n"] % WIDTH).cast("int").alias("width")))).otherwise(F.array().cast(shape))
    return F.flatten(F.transform(used, lambda x: F.concat(full(x), part(x))))


def index_path(index: Column) -> Column:
    """Decimal groups of three, all but the last led by ``x``: 1234067 is ``x001/x234/067``."""
    text = index.cast("string")
    padded = F.lpad(text, F.floor((F.length(text) + 2) / 3).cast("int") * 3, F.lit("0"))
    return F.regexp_replace(padded, r"([0-9]{3})(?=[0-9])", "x$1/")


def tile_path(level: Column, index: Column, width: Column) -> Column:
    """``tile/<level>/<index>`` with ``.p/<width>`` for partial tiles; a null level names an entry bundle."""
    return F.concat(F.lit("tile/"), F.coalesce(level.cast("string"), F.lit("entries")), F.lit("/"), index_path(index), F.when(width < WIDTH, F.concat(F.lit(".p/"), width.cast("string"))).otherwise(F.lit("")))


def parse_path(path: Column) -> Column:
    """``level`` (null: entries), ``index`` and ``width`` of a tile's path; null unless it is exactly what :func:`tile_path` makes."""
    part = lambda i: F.regexp_extract(path, r"\Atile/(entries|[0-9]{1,2})/((?:x[0-9]{3}/){0,5}[0-9]{3})(?:\.p/([0-9]{1,3}))?\z", i)
    level = part(1).try_cast("int")
    index = F.regexp_replace(part(2), "[x/]", "").try_cast("long")
    width = F.when(part(3) == "", F.lit(WIDTH)).otherwise(part(3).try_cast("int"))
    sound = (part(2) != "") & width.between(1, WIDTH) & (F.coalesce(level, F.lit(0)) < 64) & (tile_path(level, index, width) == path)
    return F.when(sound, F.struct(level.alias("level"), index.alias("index"), width.alias("width")))


def entries_at(bundle: DataFrame, wanted: DataFrame) -> DataFrame:
    """``seq``, ``entry`` of the entries whose numbers ``wanted`` (``seq``) lists: each bundle that holds one is read once.

    The numbers are grouped by bundle before the join, so of a key with very many entries one row per bundle is shuffled.
    """
    places = wanted.select("seq").distinct().groupBy(F.expr(f"seq div {WIDTH}").alias("bundle")).agg(F.collect_set(F.expr(f"cast(seq % {WIDTH} AS int)")).alias("at"))
    read = bundle_lists(bundle.join(places.select("bundle"), "bundle", "left_semi")).join(places, "bundle")
    return read.select("bundle", "entries", F.explode("at").alias("i")).select((F.col("bundle") * WIDTH + F.col("i")).alias("seq"), F.get("entries", F.col("i")).alias("entry")).filter("entry IS NOT NULL")


def bundles(log: DataFrame, seq: str = "seq", entry: str = "entry") -> DataFrame:
    """``bundle``, ``width``, ``data``: 256 entries each, every entry behind its length in two bytes."""
    one = F.concat(F.lpad(F.hex(F.length(entry)), 4, "0"), F.hex(entry))
    rows = log.groupBy(F.expr(f"{seq} div {WIDTH}").alias("bundle")).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), one.alias("x")))).alias("e"))
    return rows.select("bundle", F.size("e").alias("width"), F.unhex(F.array_join(F.transform("e", lambda x: x["x"]), "")).alias("data"))


def bundle_lists(bundle: DataFrame) -> DataFrame:
    """``bundle`` and its ``entries`` in an array; the lengths must use up the bytes exactly, else the bundle fails."""
    size = lambda acc: F.conv(F.hex(F.substr("data", acc["at"], F.lit(2))), 16, 10).cast("int")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<binary>").alias("out"))
    step = lambda acc, _: F.struct((acc["at"] + 2 + size(acc)).alias("at"), F.concat(acc["out"], F.array(F.substr("data", acc["at"] + 2, size(acc)))).alias("out"))
    read = bundle.withColumn("r", F.aggregate(F.sequence(F.lit(1), F.col("width")), start, step))
    checked = F.when(F.col("r.at") == F.length("data") + 1, F.col("r.out")).otherwise(F.raise_error(F.lit("a bundle's lengths do not fit its bytes")))
    return read.select("bundle", checked.alias("entries"))


def bundle_entries(bundle: DataFrame) -> DataFrame:
    """``seq``, ``entry`` of the entries of bundles."""
    return bundle_lists(bundle).select("bundle", F.posexplode("entries").alias("i", "entry")).select((F.col("bundle") * WIDTH + F.col("i")).alias("seq"), "entry")


def check_bundles(bundle: DataFrame, groups: DataFrame) -> DataFrame:
    """``tile``, ``checked``, ``bad``: entries of a bundle whose leaf hash is not the one in the tile (``tile``, ``hashes``), or lacks one.

    Joined on the tile, 256 entries at a time.
    """
    read = bundle_lists(bundle).select(F.col("bundle").alias("tile"), F.transform("entries", leaf_hash).alias("read"))
    none = F.array().cast("array<binary>")
    both = read.join(groups.select("tile", F.col("hashes").alias("kept")), "tile", "full_outer").select("tile", F.coalesce("read", none).alias("read"), F.coalesce("kept", none).alias("kept"))
    n = F.greatest(F.size("read"), F.size("kept"))
    wrong = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("read", i).eqNullSafe(F.get("kept", i)))
    return both.select("tile", n.cast("long").alias("checked"), F.size(wrong).cast("long").alias("bad"))


def powers(n: Column) -> Column:
    """The powers of two that sum up to n, the largest first."""
    bits = F.filter(F.sequence(F.lit(62), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", n.cast("long"), i).bitwiseAND(F.lit(1)) == 1)
    return F.transform(bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))


def checkpoint_text(origin: str, size: Column, root_base64: Column) -> Column:
    return F.concat(F.lit(origin + "\n"), size.cast("string"), F.lit("\n"), root_base64, F.lit("\n"))


def key_id(name: Column, kind: int, public_key: Column) -> Column:
    """The first four bytes, in hex, of the hash of a key's name, a newline, its kind and the key itself."""
    return F.substring(F.sha2(F.concat(F.encode(name, "UTF-8"), F.unhex(F.lit(f"0A{kind:02X}")), public_key), 256), 1, 8)
