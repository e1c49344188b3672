from auditlake.session import folders, release, work_dir
from auditlake.sources.ledger import Ledger


def test_first_come_first_served_and_cut_short(spark):
    root = work_dir(spark, "ledger")
    a, b = Ledger(spark, root), Ledger(spark, root)
    assert a.numbers() == [] and a.add(3, "three") and not b.add(3, "other") and b.add(11)
    assert a.numbers() == [3, 11] and b.note(3) == "three"
    path, fs = a._path(f"{7:012d}")
    fs.create(path, False).close()  # created, and then the writer was lost
    assert a.numbers() == [3, 11] and a.add(7, "again") and b.numbers() == [3, 7, 11] and b.note(7) == "again"


def test_working_folders_are_released(spark):
    root = work_dir(spark, "gone")
    spark.range(3).write.parquet(f"{root}/x")
    assert folders(spark, root) == ["x"]
    release(spark)
    assert folders(spark, root) == []
