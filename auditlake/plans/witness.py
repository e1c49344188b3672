"""Queries on witnesses over submissions made from the log: real checkpoints, signatures and proofs, some of them wrong in a known way."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import notes
from auditlake.operators import merkle as m
from auditlake.operators import witness as w
from auditlake.plans.merkle import _leaves

#: Logs, rounds of submissions to each, witnesses asked about each checkpoint, how many must sign, and what is kept as evidence.
LOGS, ROUNDS, WITNESSES, QUORUM, EVIDENCE = 3, 4, 5, 3, 100
#: What a log submits in a round, and the answer it deserves.
ROUND = (
    ("good", 200), ("stale", 409), ("altered proof", 422), ("unsigned", 403), ("unknown", 404), ("no empty line", 400), ("same", 200), ("other root", 422), ("beyond", 400), ("bad hash", 400), ("shortened proof", 422),
)


def _key(name: str, kind: int = notes.LOG) -> notes.Key:
    return notes.Key.from_seed(name, hashlib.sha256(name.encode()).digest(), kind)


class Tree:
    """Hashes of ranges of the log's leaves on the driver, out of the few nodes that some sizes and proofs need."""

    def __init__(self, leaves: DataFrame, sizes: list[int]) -> None:
        pairs = [(a, b) for a in sizes for b in sizes if 0 < a < b]
        want = {x for n in sizes for x in self._whole(0, n)} | {x for a, b in pairs for lo, hi in m.consistency_ranges(a, b) for x in self._whole(lo, hi)}
        rows = leaves.sparkSession.createDataFrame(sorted(want), "height int, index long")  # some logarithms
        self.nodes = {(r["height"], r["index"]): bytes(r["hash"]) for r in m.nodes(leaves, stored=True).join(F.broadcast(rows), ["height", "index"]).collect()}

    @classmethod
    def _whole(cls, low: int, high: int) -> list[tuple[int, int]]:
        """The full subtrees that make up a range of a tree, as (height, index)."""
        n = high - low
        if n & (n - 1) == 0:
            return [(n.bit_length() - 1, low // n)] if n else []
        k = 1 << (n.bit_length() - 1)
        return [*cls._whole(low, low + k), *cls._whole(low + k, high)]

    def hash(self, low: int, high: int) -> bytes:
        parts = [self.nodes[x] for x in self._whole(low, high)]
        out = parts.pop()
        while parts:
            out = notes.pair(parts.pop(), out)
        return out

    def proof(self, old: int, new: int) -> list[bytes]:
        return [self.hash(lo, hi) for lo, hi in m.consistency_ranges(old, new)]


def _sizes(n: int) -> list[int]:
    return [max(1, n * k // (ROUNDS + 1)) for k in range(1, ROUNDS + 1)]


def submissions(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """``pos``, ``body``: every log goes through the rounds; and the verifier keys of the logs. Nothing for a log too short."""
    leaves = _leaves(spark, folder)
    n = leaves.count()
    sizes, keys = _sizes(n), [_key(f"log.example/{i}") for i in range(LOGS)]
    schema = "pos long, body string"
    if n < 4 * (ROUNDS + 1):
        return spark.createDataFrame([], schema), [k.verifier for k in keys]
    tree = Tree(leaves, sorted({0, *sizes, *(s + 1 for s in sizes)}))
    flip = lambda h: bytes([h[0] ^ 1]) + h[1:]
    rows, recorded = [], 0
    for r, size in enumerate(sizes):
        root, more = tree.hash(0, size), tree.hash(0, size + 1)
        ahead = tree.proof(size, size + 1)
        for i, key in enumerate(keys):
            sign = lambda at, top, k=key: notes.sign_note(notes.Checkpoint(k.name, at, top).text, k)
            proof = tree.proof(recorded, size) if recorded else []
            bodies = {
                "good": w.request(recorded, proof, sign(size, root)), "stale": w.request(size - 1, ahead, sign(size + 1, more)), "altered proof": w.request(size, [flip(ahead[0]), *ahead[1:]], sign(size + 1, more)),
                "unsigned": w.request(size, ahead, notes.sign_note(notes.Checkpoint(key.name, size + 1, more).text, _key("someone.else"))), "unknown": w.request(0, [], sign(size, root, _key("log.unknown"))),
                "no empty line": w.request(size, [], sign(size, root)).replace("\n\n", "\n"), "same": w.request(size, [], sign(size, root)), "other root": w.request(size, [], sign(size, flip(root))),
                "beyond": w.request(size + 2, [], sign(size + 1, more)), "bad hash": w.request(size, [b"short"], sign(size + 1, more)), "shortened proof": w.request(size, ahead[:-1], sign(size + 1, more)),
            }
            rows += [((r * len(ROUND) + j) * LOGS + i, bodies[what]) for j, (what, _) in enumerate(ROUND)]
        recorded = size
    return spark.createDataFrame(rows, schema), [k.verifier for k in keys]


def witness_decision(spark: SparkSession, folder: str) -> DataFrame:
    return w.decisions(*submissions(spark, folder))


def retained_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The newest submissions that a log signed and that yet do not extend what it signed before."""
    return witness_decision(spark, folder).filter("status = 422").orderBy(F.desc("pos")).limit(EVIDENCE).select("pos", "origin")


def _answers(spark: SparkSession, folder: str) -> tuple[DataFrame, notes.Key, list[notes.Key]]:
    """What each witness answers about each checkpoint: witness j signs checkpoint k, another text, or not at all."""
    leaves = _leaves(spark, folder)
    n, key = leaves.count(), _key("log.example/0")
    witnesses = [_key(f"witness.example/{j}", notes.COSIGNATURE) for j in range(WITNESSES)]
    sizes = sorted(set(_sizes(n))) if n else []
    tree = Tree(leaves, sizes)
    rows = []
    for k, size in enumerate(sizes):
        point = notes.Checkpoint(key.name, size, tree.hash(0, size))
        note = notes.sign_note(point.text, key)
        for j, x in enumerate(witnesses):
            other = notes.Checkpoint(key.name, size + 1, point.root).text
            rows.append((size, x.name, 1_700_000_000 + 60 * k + j, note, notes.signature_line(x, point.text if j <= k + 1 else other, 1_700_000_000 + 60 * k + j)))
    return spark.createDataFrame(rows, "checkpoint long, witness string, at long, note string, lines string"), key, witnesses


def witness_quorum(spark: SparkSession, folder: str) -> DataFrame:
    """Per checkpoint: the witnesses whose cosignature really signs it, and whether they are enough."""
    answers, key, witnesses = _answers(spark, folder)
    good = w.cosigned(answers, key.verifier, [x.verifier for x in witnesses]).groupBy("checkpoint").agg(F.count(F.lit(1)).alias("cosigned"))
    every = answers.select("checkpoint").distinct().join(good, "checkpoint", "left").withColumn("cosigned", F.coalesce("cosigned", F.lit(0)))
    return every.withColumn("ok", F.col("cosigned") >= QUORUM)


def witness_status(spark: SparkSession, folder: str) -> DataFrame:
    """Per witness: the largest size it cosigned, its last success and failure, by what its answers really sign."""
    answers, key, witnesses = _answers(spark, folder)
    good = w.cosigned(answers, key.verifier, [x.verifier for x in witnesses]).withColumn("status", F.lit(200))
    return w.progress(answers.join(good, ["checkpoint", "witness"], "left").select("witness", "at", F.col("checkpoint").alias("size"), "status"))


QUERIES = {f.__name__: f for f in (witness_decision, retained_evidence, witness_quorum, witness_status)}

# The SQL knows what was submitted, and nothing of bytes, signatures and proofs.
_N = "n AS (SELECT count(DISTINCT event_id) AS n FROM append_items)"
_DECISION = f"""{_N}, kinds(j, what, status) AS (VALUES {', '.join(f"({j}, '{what}', {status})" for j, (what, status) in enumerate(ROUND))}),
s AS (SELECT (r * {len(ROUND)} + j) * {LOGS} + i AS pos, CASE WHEN what = 'unknown' THEN 'log.unknown' WHEN what IN ('no empty line', 'bad hash') THEN NULL ELSE 'log.example/' || i END AS origin, cast(status AS integer) AS status, what,
  CASE WHEN what IN ('no empty line', 'bad hash') THEN NULL WHEN what = 'unknown' THEN 0 WHEN what = 'good' THEN CASE WHEN r = 0 THEN 0 ELSE greatest(1, n * r // {ROUNDS + 1}) END ELSE greatest(1, n * (r + 1) // {ROUNDS + 1}) END AS recorded
  FROM kinds, range({ROUNDS}) a(r), range({LOGS}) b(i), n WHERE n >= {4 * (ROUNDS + 1)})"""
_ANSWERS = f"""{_N}, a AS (SELECT greatest(1, n * (k + 1) // {ROUNDS + 1}) AS checkpoint, 'witness.example/' || j AS witness, 1700000000 + 60 * k + j AS t, j <= k + 1 AS good FROM n, range({ROUNDS}) x(k), range({WITNESSES}) y(j))"""
SQL = {
    "witness_decision": f"WITH {_DECISION} SELECT pos, origin, status, recorded FROM s",
    "retained_evidence": f"WITH {_DECISION} SELECT pos, origin FROM s WHERE status = 422 ORDER BY pos DESC LIMIT {EVIDENCE}",
    "witness_quorum": f"WITH {_ANSWERS} SELECT checkpoint, count(*) FILTER (WHERE good) AS cosigned, count(*) FILTER (WHERE good) >= {QUORUM} AS ok FROM a GROUP BY checkpoint",
    "witness_status": f"WITH {_ANSWERS} SELECT witness, max(checkpoint) FILTER (WHERE good) AS size, max(t) FILTER (WHERE good) AS cosigned_at, max(t) FILTER (WHERE NOT good) AS failed_at, coalesce(max(t) FILTER (WHERE NOT good) > coalesce(max(t) FILTER (WHERE good), -1), false) AS failing FROM a GROUP BY witness",
}
