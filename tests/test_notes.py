import pytest

from auditlake import notes as n

SEED = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")


def test_ed25519_published_vectors():
    pub = n.public_key(SEED)
    assert pub.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = n.sign(SEED, b"")
    assert sig.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert n.verify(pub, b"", sig) and not n.verify(pub, b"x", sig)
    for i in (0, 31, 32, 63):
        assert not n.verify(pub, b"", sig[:i] + bytes([sig[i] ^ 1]) + sig[i + 1 :])
    assert not n.verify(pub, b"", sig[:-1]) and not n.verify(pub[:-1], b"", sig)


def test_published_note():
    key = n.Key.parse("PRIVATE+KEY+PeterNeumann+c74f20a3+AYEKFALVFGyNhPJEMzD1QIDr+Y7hfZx09iUvxdXHKDFz")
    text = "If you think cryptography is the answer to your problem,\nthen you don't know what your problem is.\n"
    note = text + "\n— PeterNeumann x08go/ZJkuBS9UG/SffcvIAQxVBtiFupLLr8pAcElZInNIuGUgYN1FFYC2pZSNXgKvqfqdngotpRZb6KE6RyyBwJnAM=\n"
    assert n.sign_note(text, key) == note
    assert n.open_note(note, [n.Key.parse(key.verifier)]) == (text, {"PeterNeumann": None})


@pytest.fixture(scope="module")
def keys():
    return n.Key.from_seed("log.example/a", SEED), [n.Key.from_seed(f"w{i}", bytes([i]) * 32, n.COSIGNATURE) for i in range(3)]


def test_checkpoint_with_witnesses(keys):
    log, witnesses = keys
    cp = n.Checkpoint("log.example/a", 42, bytes(32), ("extra",))
    note = n.sign_note(cp.text, log) + "".join(n.signature_line(w, cp.text, 1000 + i) for i, w in enumerate(witnesses[:2]))
    public = [n.Key.parse(w.verifier) for w in witnesses]
    assert n.open_checkpoint(note, log, public, 2) == cp
    with pytest.raises(n.SignatureFailure):
        n.open_checkpoint(note, log, public, 3)
    assert n.open_note(note, public)[1] == {"w0": 1000, "w1": 1001}
    with pytest.raises(n.SignatureFailure):
        n.open_note(note.replace("42", "43"), [log])
    with pytest.raises(n.SignatureFailure):
        n.open_note(note, [n.Key.from_seed("other", SEED)])


def test_malformed(keys):
    log, _ = keys
    good = n.sign_note("a\n", log)
    for bad in ("a", "a\n", good[:-1], good + good.split("\n\n")[1], good.replace("— ", "- "), good.replace("=\n", "\n"), "\x01" + good):
        with pytest.raises(n.NoteError):
            n.open_note(bad, [log])
    for bad in ("o\n1\n", "o\n01\n" + "A" * 43 + "=\n", "o\n1\nAAAA\n", "o\n1\n" + "A" * 43 + "=", "o\n-1\n" + "A" * 43 + "=\n"):
        with pytest.raises(n.NoteError):
            n.Checkpoint.parse(bad)
    for bad in ("x", "a+b+c", log.verifier[:-1], log.verifier.replace("+", "+0", 1)):
        with pytest.raises(n.NoteError):
            n.Key.parse(bad)
    with pytest.raises(n.NoteError):
        n.sign_note("a\n", log, log)
