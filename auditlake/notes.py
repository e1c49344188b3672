"""Signed notes, checkpoints and cosignatures, and checks of a few hashes: work for the driver, without a cluster.

Formats are the public ones of signed notes, transparency-log checkpoints and cosignatures (C2SP); Ed25519 is RFC 8032 in
plain Python, which is fast enough for one checkpoint at a time.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from dataclasses import dataclass

# Ed25519 -------------------------------------------------------------------------------------------------------------

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)
Point = tuple[int, int, int, int]  # X, Y, Z, T with x = X/Z, y = Y/Z, xy = T/Z


def _add(a: Point, b: Point) -> Point:
    e = (a[1] - a[0]) * (b[1] - b[0]) % _P
    f = (a[1] + a[0]) * (b[1] + b[0]) % _P
    g, h = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    x, y, z, t = f - e, h - g, h + g, f + e
    return x * y % _P, t * z % _P, y * z % _P, x * t % _P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a, n = _add(a, a), n >> 1
    return out


def _x(y: int, odd: int) -> int | None:
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    if not square:
        return None if odd else 0
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _I % _P
    if (x * x - square) % _P:
        return None
    return _P - x if x & 1 != odd else x


_BY = 4 * pow(5, -1, _P) % _P
_BASE: Point = (_x(_BY, 0), _BY, 1, _x(_BY, 0) * _BY % _P)


def _pack(a: Point) -> bytes:
    z = pow(a[2], -1, _P)
    x, y = a[0] * z % _P, a[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(s: bytes) -> Point | None:
    if len(s) != 32:
        return None
    n = int.from_bytes(s, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % _P)


def _expand(seed: bytes) -> tuple[int, bytes]:
    if len(seed) != 32:
        raise ValueError("an Ed25519 seed has 32 bytes")
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return a, h[32:]


def _mod(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_expand(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _expand(seed)
    pub = _pack(_times(a, _BASE))
    r = _mod(prefix, message)
    big = _pack(_times(r, _BASE))
    return big + ((r + _mod(big, pub, message) * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(signature) != 64:
        return False
    a, r = _unpack(public), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    left, right = _times(s, _BASE), _add(r, _times(_mod(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0


# Notes ---------------------------------------------------------------------------------------------------------------

#: Kinds of signature (fixed values): of a log, of a witness.
LOG, COSIGNATURE = 1, 4
DASH = "— "
MAX_SIGNATURES = 100


class NoteError(ValueError):
    """The note is malformed."""


class SignatureFailure(NoteError):
    """The note is well formed, but not signed as it should be."""


@dataclass(frozen=True)
class Key:
    """A named key; ``seed`` is there for signers only."""

    name: str
    kind: int
    public: bytes
    seed: bytes | None = None

    def __post_init__(self) -> None:
        if not self.name or re.search(r"[\s+\x00-\x1f]", self.name):
            raise NoteError("a key's name has no white space, plus sign or control character")

    @property
    def key_id(self) -> bytes:
        return hashlib.sha256(self.name.encode() + b"\n" + bytes([self.kind]) + self.public).digest()[:4]

    @property
    def verifier(self) -> str:
        return f"{self.name}+{self.key_id.hex()}+{_b64(bytes([self.kind]) + self.public)}"

    @classmethod
    def from_seed(cls, name: str, seed: bytes, kind: int = LOG) -> Key:
        return cls(name, kind, public_key(seed), seed)

    @classmethod
    def parse(cls, text: str) -> Key:
        """A verifier key (name+id+key) or a signer key (the same behind ``PRIVATE+KEY+``); the id must fit the key."""
        private = text.startswith("PRIVATE+KEY+")
        parts = text.removeprefix("PRIVATE+KEY+").split("+", 2)
        if len(parts) != 3:
            raise NoteError("a key has a name, an id and the key")
        raw = _unb64(parts[2])
        if len(raw) != 33 or raw[0] not in (LOG, COSIGNATURE):
            raise NoteError("unknown kind or length of key")
        key = cls.from_seed(parts[0], raw[1:], raw[0]) if private else cls(parts[0], raw[0], raw[1:])
        if key.key_id.hex() != parts[1]:
            raise NoteError("the key's id does not fit the key")
        return key


def _b64(b: bytes) -> str:
    return base64.b64encode(b).decode()


def _unb64(s: str) -> bytes:
    try:
        raw = base64.b64decode(s, validate=True)
    except (binascii.Error, ValueError) as e:
        raise NoteError("not base64") from e
    if _b64(raw) != s:
        raise NoteError("base64 is not canonical")
    return raw


def _check_text(text: str) -> None:
    if not text.endswith("\n") or re.search(r"[\x00-\x09\x0b-\x1f]", text):
        raise NoteError("a note ends with a newline and has no other control characters")


def _signed(key: Key, text: str, time: int | None) -> bytes:
    return text.encode() if key.kind == LOG else f"cosignature/v1\ntime {time}\n".encode() + text.encode()


def signature_line(key: Key, text: str, time: int | None = None) -> str:
    """One signature of a note's text; a witness's needs the time (seconds)."""
    _check_text(text)
    if key.seed is None or (key.kind == COSIGNATURE) != (time is not None):
        raise NoteError("signing needs the private key, and a time just for cosignatures")
    stamp = b"" if time is None else time.to_bytes(8, "big")
    return f"{DASH}{key.name} {_b64(key.key_id + stamp + sign(key.seed, _signed(key, text, time)))}\n"


def sign_note(text: str, *keys: Key) -> str:
    if not keys or len({(k.name, k.key_id) for k in keys}) < len(keys):
        raise NoteError("a note has at least one signer, and none twice")
    return text + "\n" + "".join(signature_line(k, text) for k in keys)


def open_note(note: str, keys: list[Key]) -> tuple[str, dict[str, int | None]]:
    """The text, and by name of the keys that verified the time of their cosignature (none for logs).

    Signatures of unknown keys are ignored; a bad one of a known key rejects the note, and at least one must be good.
    """
    _check_text(note)
    at = note.rfind("\n\n")
    lines = note[at + 2 :].split("\n")[:-1] if at >= 0 else []
    if not lines or len(lines) > MAX_SIGNATURES:
        raise NoteError("a note has between one signature and a hundred")
    text, seen, good = note[: at + 1], set(), {}
    for line in lines:
        m = re.fullmatch(rf"{DASH}([^\s+]+) (\S+)", line)
        if not m or len(raw := _unb64(m[2])) < 5:
            raise NoteError("malformed signature line")
        if (m[1], raw[:4]) in seen:
            raise NoteError("two signatures of one key")
        seen.add((m[1], raw[:4]))
        key = next((k for k in keys if k.name == m[1] and k.key_id == raw[:4]), None)
        if key is None:
            continue
        time = int.from_bytes(raw[4:12], "big") if key.kind == COSIGNATURE else None
        if not verify(key.public, _signed(key, text, time), raw[4:] if time is None else raw[12:]):
            raise SignatureFailure(f"bad signature of {key.name}")
        good[key.name] = time
    if not good:
        raise SignatureFailure("no signature of a known key")
    return text, good


@dataclass(frozen=True)
class Checkpoint:
    origin: str
    size: int
    root: bytes
    extensions: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        if not self.origin or "\n" in self.origin or self.size < 0 or len(self.root) != 32 or any(not e or "\n" in e for e in self.extensions):
            raise NoteError("not a checkpoint")
        return "".join(f"{x}\n" for x in (self.origin, self.size, _b64(self.root), *self.extensions))

    @classmethod
    def parse(cls, text: str) -> Checkpoint:
        lines = text.split("\n")
        if len(lines) < 4 or lines.pop() or not re.fullmatch("0|[1-9][0-9]*", lines[1]) or int(lines[1]) >= 2**53:
            raise NoteError("a checkpoint has an origin, a size and a root, a line each")
        out = cls(lines[0], int(lines[1]), _unb64(lines[2]), tuple(lines[3:]))
        if out.text != text:
            raise NoteError("the checkpoint is not in its one form")
        return out


def open_checkpoint(note: str, log: Key, witnesses: list[Key] = (), quorum: int = 0) -> Checkpoint:
    """The checkpoint of a note that the log and at least ``quorum`` of the witnesses signed."""
    text, good = open_note(note, [log, *witnesses])
    if log.name not in good or sum(w.name in good for w in witnesses) < quorum:
        raise SignatureFailure("the log's signature or witnesses are missing")
    out = Checkpoint.parse(text)
    if out.origin != log.name:
        raise NoteError("the origin is not the log's")
    return out


# Proofs --------------------------------------------------------------------------------------------------------------


def leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\1" + left + right).digest()


def roots_of_proof(old: int, new: int, old_root: bytes, proof: list[bytes]) -> tuple[bytes, bytes] | None:
    """The roots of both trees that a consistency proof stands for (RFC 9162, 2.1.4.2); none if its length is wrong."""
    if not 0 < old <= new:
        return None
    if old == new:
        return (old_root, old_root) if not proof else None
    nodes = list(proof)
    if old & (old - 1) == 0:  # a whole subtree: the old root itself starts the path
        nodes.insert(0, old_root)
    if not nodes:
        return None
    fn, sn = old - 1, new - 1
    while fn & 1:
        fn, sn = fn >> 1, sn >> 1
    a = b = nodes[0]
    for c in nodes[1:]:
        if sn == 0:
            return None
        if fn & 1 or fn == sn:
            a, b = pair(c, a), pair(c, b)
            while not fn & 1 and fn:
                fn, sn = fn >> 1, sn >> 1
        else:
            b = pair(b, c)
        fn, sn = fn >> 1, sn >> 1
    return (a, b) if sn == 0 else None
