"""Every registered query of the core runs, and equals its SQL where it has one."""

import pytest

from auditlake.plans import audit, log, merkle, problems, streams, witness
from oracle import compare

QUERIES = {n: f for part in (problems, log, merkle, audit, streams, witness) for n, f in part.QUERIES.items()}
SQL = {n: s for part in (problems, log, merkle, audit, streams, witness) for n, s in part.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folder, name):
    compare(spark, folder, QUERIES[name], SQL[name])


def test_seen_answers_and_rate(spark, folder):
    answers = {r.item_pos: r.seen for r in problems.p5_answers(spark, folder).collect()}
    repeats = {r.item_pos for r in problems.p5_found(spark, folder).collect()}
    assert all(answers[p] for p in repeats)
    rate = problems.p5_rate(spark, folder).first()
    assert rate.missed == 0 and rate.repeats == len(repeats) and rate.wrong == sum(bool(x) for x in answers.values()) - len(repeats)
    assert rate.wrong_rate <= rate.bound


def test_entry_point(spark, folder):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
