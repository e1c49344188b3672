"""Witnessing logs: submitted checkpoints, judged from their bytes, and what is known of the witnesses themselves.

A submission's body is the text of the public tlog-witness protocol: a line with the old size, lines with a consistency proof, an empty
line and a signed checkpoint. Reading it and checking signatures needs no state and runs in parallel over all submissions; only
the comparison with the size on record goes origin by origin, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import notes
from auditlake.session import ship

#: The most lines of a proof, and the form of a size (fixed by the protocol).
MAX_PROOF = 63
SIZE = re.compile("0|[1-9][0-9]{0,15}")
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def request(old: int, proof: Sequence[bytes], note: str) -> str:
    """The body of a submission."""
    return "\n".join([f"old {old}", *(notes._b64(h) for h in proof), "", note])


def parse_size(text: str) -> int:
    """A decimal number without sign or leading zeros."""
    if not SIZE.fullmatch(text) or int(text) >= 2**53:
        raise notes.NoteError("not a size")
    return int(text)


def parse_request(body: str) -> tuple[int, list[bytes], str]:
    head, empty, note = body.partition("\n\n")
    first, *lines = head.split("\n")
    if not empty or not note or not first.startswith("old ") or len(lines) > MAX_PROOF:
        raise notes.NoteError("a submission has an old size, at most 63 hashes, an empty line and a checkpoint")
    proof = [notes._unb64(x) for x in lines]
    if any(len(h) != 32 for h in proof):
        raise notes.NoteError("a hash has 32 bytes")
    return parse_size(first[4:]), proof, note


def signature_lines(body: str) -> list[str]:
    """The lines of a witness's answer, in form; what they sign is for :func:`cosigned` to find out."""
    lines = body.split("\n")
    if lines.pop() or not lines or not all(re.fullmatch(r"— [^\s+]+ [A-Za-z0-9+/]+={0,2}", x) for x in lines):
        raise notes.NoteError("an answer is a number of signature lines")
    return [f"{x}\n" for x in lines]


def opened(body: str | None, keys: dict[str, list[notes.Key]]) -> tuple[int, str | None, int | None, int | None, bytes | None, list[bytes] | None]:
    """What can be said of a submission without a record: status (0: so far good), origin, old size, size, root and proof."""
    try:
        old, proof, note = parse_request(body or "")
    except notes.NoteError:
        return 400, None, None, None, None, None
    origin = note.split("\n", 1)[0]
    if not keys.get(origin):
        return 404, origin, None, None, None, None
    try:
        text, _ = notes.open_note(note, keys[origin])
        point = notes.Checkpoint.parse(text)
    except notes.SignatureFailure:
        return 403, origin, None, None, None, None
    except notes.NoteError:
        return 400, origin, None, None, None, None
    good = point.origin == origin and old <= point.size
    return (0 if good else 400), origin, old, point.size, point.root, proof


def extends(old: int, size: int, old_root: bytes | None, root: bytes, proof: list[bytes]) -> bool:
    """Whether a checkpoint continues the one on record (none: old size 0)."""
    if size == 0:
        return root.hex() == EMPTY and not proof
    return not proof if old == 0 else notes.roots_of_proof(old, size, old_root, proof) == (old_root, root)


def decisions(submissions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pos``, ``origin``, ``status`` and ``recorded`` (the size on record before) of every submission.

    ``submissions``: ``pos`` (long, their order), ``body`` (text). ``keys``: verifier keys of the trusted logs; a log's origin is its
    key's name. Status: 400 malformed, or the old size beyond the size; 404 unknown origin; 403 no trusted signature; 409 the old size
    is not the one on record; 422 the checkpoint does not extend it; else 200, which puts size and root on record. A null body
    is malformed. A submission whose origin cannot be read has a null origin and no record. Each origin's sound submissions
    pass through one task in order; nothing but the record is kept.
    """
    ship(submissions.sparkSession)
    texts = list(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[notes.Key]] = {}
        for k in map(notes.Key.parse, texts):
            known.setdefault(k.name, []).append(k)
        for b in batches:
            got = list(zip(*(opened(x, known) for x in b.column("body").to_pylist()), strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("pos"), *[pa.array(c, t) for c, t in zip(got, kinds, strict=True)]], ["pos", "status", "origin", "old", "size", "root", "proof"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, size, root = None, 0, None
        for b in batches:
            status, recorded = [], []
            for name, code, old, new, new_root, proof in zip(*(b.column(c).to_pylist() for c in ("origin", "status", "old", "size", "root", "proof")), strict=True):
                if name != origin:
                    origin, size, root = name, 0, None
                recorded.append(size if name is not None else None)
                if not code:
                    code = 409 if old != size else 200 if extends(old, new, root, new_root, proof) else 422
                    if code == 200:
                        size, root = new, new_root
                status.append(code)
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("origin"), pa.array(status, pa.int32()), pa.array(recorded, pa.int64())], ["pos", "origin", "status", "recorded"])

    first = submissions.select("pos", "body").repartition("pos").mapInArrow(read, "pos long, status int, origin string, old long, size long, root binary, proof array<binary>")
    return first.repartition("origin").sortWithinPartitions("origin", "pos").mapInArrow(judge, "pos long, origin string, status int, recorded long")


def cosigned(answers: DataFrame, log: str, witnesses: Sequence[str]) -> DataFrame:
    """``checkpoint``, ``witness``: whose cosignatures really sign a checkpoint.

    ``answers``: ``checkpoint`` (any), ``note`` (the log's signed checkpoint), ``lines`` (a witness's answer). A note the log did not
    sign, or an answer in another form, counts for nobody; lines of unknown witnesses are passed over; null rows too.
    """
    ship(answers.sparkSession)
    kind = answers.schema["checkpoint"].dataType.simpleString()
    names = list(witnesses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keys = notes.Key.parse(log), [notes.Key.parse(w) for w in names]
        for b in batches:
            at, who = [], []
            for i, (note, lines) in enumerate(zip(b.column("note").to_pylist(), b.column("lines").to_pylist(), strict=True)):
                try:
                    _, good = notes.open_note((note or "") + "".join(signature_lines(lines or "")), [key, *keys])
                except notes.NoteError:
                    continue
                found = [k.name for k in keys if k.name in good and key.name in good]
                at += [i] * len(found)
                who += found
            yield pa.RecordBatch.from_arrays([b.column("checkpoint").take(pa.array(at, pa.int64())), pa.array(who, pa.string())], ["checkpoint", "witness"])

    return answers.select("checkpoint", "note", "lines").mapInArrow(run, f"checkpoint {kind}, witness string").distinct()


def progress(attempts: DataFrame) -> DataFrame:
    """Per ``witness``: the largest size it cosigned, its last success and failure (``at``), and whether it fails since.

    ``attempts``: ``witness``, ``at`` (long), ``size``, ``status``. Aggregates combine on the map side.
    """
    good = F.col("status") == 200
    when = lambda c: F.max(F.when(c, F.col("at")))
    g = attempts.groupBy("witness").agg(F.max(F.when(good, F.col("size"))).alias("size"), when(good).alias("cosigned_at"), when(~F.coalesce(good, F.lit(False))).alias("failed_at"))
    failing: Column = F.coalesce(F.col("failed_at") > F.coalesce("cosigned_at", F.lit(-1)), F.lit(False))
    return g.withColumn("failing", failing)
