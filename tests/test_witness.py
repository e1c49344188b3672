import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditlake import notes
from auditlake.operators import witness as w
from test_merkle import leaf_list, naive, ranges_by_recursion

LOG, OTHER = (notes.Key.from_seed(n, hashlib.sha256(n.encode()).digest()) for n in ("log.example/a", "log.example/b"))
LEAVES = leaf_list(40)


def point(size, key=LOG, root=None, extra=()):
    root = root or (naive(LEAVES[:size]) if size else bytes.fromhex(w.EMPTY))
    return notes.sign_note(notes.Checkpoint(key.name, size, root, extra).text, key)


def proof(old, new):
    return [naive(LEAVES[lo:hi]) for lo, hi in ranges_by_recursion(old, 0, new)] if old and old < new else []


def statuses(spark, bodies, keys=(LOG,)):
    df = spark.createDataFrame(list(enumerate(bodies)), "pos long, body string").repartition(3)
    return {r["pos"]: (r["status"], r["recorded"]) for r in w.decisions(df, [k.verifier for k in keys]).collect()}


def test_body_there_and_back():
    body = w.request(3, [bytes(32), bytes([7] * 32)], point(5))
    assert w.parse_request(body) == (3, [bytes(32), bytes([7] * 32)], point(5))
    for bad in ("", "old 3\n" + point(5), body.replace("old 3", "old 03"), body.replace("old 3", "old -3"), body.replace("old", "new"), "old 1\nAAAA\n\n" + point(5), "old 1\n" + "x\n" * 64 + "\n" + point(5), "old 1\n\n", "old 1\n!!\n\nx"):
        with pytest.raises(notes.NoteError):
            w.parse_request(bad)
    assert w.signature_lines("— a.b AAAA\n— c AA==\n") == ["— a.b AAAA\n", "— c AA==\n"]
    for bad in ("", "— a AAAA", "a AAAA\n", "— a+b AAAA\n", "— a AAAA\n\n"):
        with pytest.raises(notes.NoteError):
            w.signature_lines(bad)


def test_every_status(spark):
    flipped = [bytes([proof(8, 20)[0][0] ^ 1]) + proof(8, 20)[0][1:], *proof(8, 20)[1:]]
    steps = [
        (w.request(0, [bytes(32)], point(0)), 422), (w.request(0, [], point(0)), 200), (w.request(0, [], point(0, root=bytes(32))), 422), (w.request(0, [bytes(32)], point(8)), 422), (w.request(0, [], point(8)), 200),
        (w.request(0, [], point(8)), 409), (w.request(8, flipped, point(20)), 422), (w.request(8, proof(8, 20)[:-1], point(20)), 422), (w.request(8, proof(8, 20), point(20, root=bytes(32))), 422),
        (w.request(8, proof(8, 20), point(20, key=OTHER)), 404), (w.request(8, proof(8, 20), point(20).replace("log.example/a\n20", "log.example/a\n21")), 403), (w.request(9, [], point(8)), 400), (w.request(8, [], "log.example/a\nno note"), 400),
        (None, 400), ("", 400), (w.request(8, proof(8, 20), point(20, extra=("more",))), 200), (w.request(20, [], point(20)), 200), (w.request(20, proof(20, 40), point(40)), 200), (w.request(20, proof(20, 40), point(40)), 409),
    ]
    got = statuses(spark, [b for b, _ in steps])
    assert [got[i][0] for i in range(len(steps))] == [s for _, s in steps]
    assert got[len(steps) - 1][1] == 40
    assert statuses(spark, []) == {}


def test_origins_do_not_disturb_each_other(spark):
    r = random.Random(4)
    sizes, bodies, want = {LOG: 0, OTHER: 0}, [], []
    for _ in range(30):
        key = r.choice([LOG, OTHER])
        new = r.randint(sizes[key], 40)
        bodies.append(w.request(sizes[key], proof(sizes[key], new), point(new, key)))
        want.append((200, sizes[key]))
        sizes[key] = new
    got = statuses(spark, bodies, (LOG, OTHER))
    assert [got[i] for i in range(30)] == want


def test_cosignatures_and_progress(spark):
    witnesses = [notes.Key.from_seed(f"w{i}", bytes([i] * 32), notes.COSIGNATURE) for i in range(3)]
    text = notes.Checkpoint(LOG.name, 8, naive(LEAVES[:8])).text
    lines = [notes.signature_line(x, text, 100 + i) for i, x in enumerate(witnesses)]
    rows = [(1, point(8), lines[0]), (1, point(8), lines[0] + lines[1]), (1, point(8), notes.signature_line(witnesses[2], text.replace("8", "9", 1), 5)), (2, point(8, OTHER), lines[0]), (3, point(8), "junk"), (4, None, None), (None, point(8), lines[2])]
    got = w.cosigned(spark.createDataFrame(rows, "checkpoint long, note string, lines string"), LOG.verifier, [x.verifier for x in witnesses]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "w0"), (1, "w1"), (None, "w2")], key=repr)
    tries = spark.createDataFrame([("a", 1, 5, 200), ("a", 2, 9, 409), ("b", 1, 5, None), ("b", 2, 7, 200), ("c", 1, 5, 422)], "witness string, at long, size long, status int")
    assert {r["witness"]: (r["size"], r["cosigned_at"], r["failed_at"], r["failing"]) for r in w.progress(tries).collect()} == {"a": (5, 1, 2, True), "b": (7, 2, 1, False), "c": (None, None, 1, True)}
    assert w.progress(tries.filter(F.lit(False))).count() == 0
