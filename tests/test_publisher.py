import pytest

from auditlake import notes
from auditlake.api import AuditLake
from auditlake.errors import LogDiverged, NotVerifiable
from auditlake.session import work_dir
from auditlake.sources.publisher import Publisher

KEY = notes.Key.from_seed("log.example/t", bytes(32))


def log(spark, n, change=None):
    return spark.createDataFrame([(i, f"entry {i}{'!' if i == change else ''}".encode()) for i in range(n)], "seq long, entry binary").repartition(3)


def contents(p):
    return {r["path"]: bytes(r["data"]) for r in p.stored().collect()}


def test_publish_in_steps_again_and_verify(spark):
    p = Publisher(spark, work_dir(spark, "pub"), KEY)
    with pytest.raises(NotVerifiable):
        p.verify()
    first = p.publish(log(spark, 600), 300)
    assert first.size == 300 and p.live() == first == p.verify()
    before = contents(p)
    second = p.publish(log(spark, 600), 600)
    after = contents(p)
    assert p.verify() == second and {k: after[k] for k in before} == before and len(p.stored().collect()) == len(after)
    assert p.publish(log(spark, 600), 600) == second and contents(p) == after
    whole = Publisher(spark, work_dir(spark, "pub"), KEY)
    assert whole.publish(log(spark, 600), 600) == second  # as if in one step
    assert all(after[k] == v for k, v in contents(whole).items())


def test_crash_between_the_writes(spark, monkeypatch):
    p = Publisher(spark, work_dir(spark, "pub"), KEY)
    old = p.publish(log(spark, 300), 256)
    for step in ("root", "sign_note"):
        where = "auditlake.operators.merkle.edge_root" if step == "root" else "auditlake.notes.sign_note"
        with monkeypatch.context() as patch:
            patch.setattr(where, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                p.publish(log(spark, 300), 300)
        assert p.live() == old  # the checkpoint never runs ahead
    new = p.publish(log(spark, 300), 300)
    assert new.size == 300 and p.verify() == new


def test_refusals(spark):
    p = Publisher(spark, work_dir(spark, "pub"), KEY)
    p.publish(log(spark, 300), 300)
    for bad, size in ((log(spark, 300), 299), (log(spark, 310), 320), (log(spark, 400, change=290), 400), (log(spark, 400).filter("seq <> 350"), 400)):
        with pytest.raises(LogDiverged):
            p.publish(bad, size)
    assert p.live().size == 300
    p.audit(log(spark, 400))
    for bad in (log(spark, 400, change=5), log(spark, 299)):  # behind the last full bundle only an audit of the whole log looks
        with pytest.raises(LogDiverged):
            p.audit(bad)


def test_of_two_publishers_one_wins(spark):
    root = work_dir(spark, "pub")
    a, b = Publisher(spark, root, KEY), Publisher(spark, root, KEY)
    a.publish(log(spark, 300), 300)
    seen = b.steps.numbers()
    b.steps.numbers = lambda: seen  # what it saw before the other went on
    new = a.publish(log(spark, 400), 400)
    with pytest.raises(LogDiverged):
        b.publish(log(spark, 350), 350)
    assert a.live() == new == a.verify()


def test_facade(spark, folder):
    lake = AuditLake(spark, folder)
    assert lake.key_history(limit=2).count() == 2 and "merkle_root" in dir(lake)
    with pytest.raises(AttributeError):
        lake.nothing  # noqa: B018
