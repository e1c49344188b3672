"""Differences between two copies of a dataset.

Both sides are tagged and united, grouped once by key with one struct kept per side, and the structs are compared field
by field in generated higher-order SQL. One shuffle of the narrow rows; the aggregate combines on the map side, so a key
that holds a large share of the rows reaches the reducers as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    left_version: Sequence[str] = (),
    right_version: Sequence[str] = (),
    left_deleted: str | None = None,
    right_deleted: str | None = None,
    names: tuple[str, str] = ("only_left", "only_right"),
    unknown_left: bool = False,
    values: bool = True,
) -> DataFrame:
    """One row per difference: the key columns, ``difference`` and (with ``values``) both values as text.

    ``difference`` is ``names[0]`` or ``names[1]`` for a key on one side only, ``deleted`` where the sides disagree
    whether the key exists, else the name of a field that is not equal.

    - Several rows of one key on one side: the one greatest by that side's ``version`` columns counts (ties: the
      greatest by the fields, so the result is the same in any order); repeated rows change nothing.
    - ``left_deleted`` / ``right_deleted`` name a boolean tombstone column. A tombstone on one side and no row on the
      other is no difference; null counts as not deleted.
    - Nulls: a null key is a key like any other and equals null. Field values compare null-safe; with
      ``unknown_left`` a null on the left is unknown and never a difference.
    - Other columns are ignored, whatever they are called; empty tables give one-sided differences or no rows.
    """

    def side(df: DataFrame, tag: int, version: Sequence[str], deleted: str | None) -> DataFrame:
        gone = F.coalesce(df[quoted(deleted)], F.lit(False)) if deleted else F.lit(False)
        ver = [df[quoted(v)].alias(f"v{i}") for i, v in enumerate(version)] or [F.lit(0).alias("v0")]
        body = F.struct(F.struct(*ver).alias("v"), F.struct(*[df[quoted(f)].alias(f"f{i}") for i, f in enumerate(fields)]).alias("f"), gone.alias("gone"))
        both = [body.alias("l"), F.lit(None).alias("r")] if tag == 0 else [F.lit(None).alias("l"), body.alias("r")]
        return df.select(*[df[quoted(k)].alias(f"k{i}") for i, k in enumerate(keys)], *both)

    a, b = side(left, 0, left_version, left_deleted), side(right, 1, right_version, right_deleted)
    a = a.withColumn("r", F.lit(None).cast(b.schema["r"].dataType))
    b = b.withColumn("l", F.lit(None).cast(a.schema["l"].dataType))
    # max() of a struct is its greatest version, and skips nulls: one struct is kept per side.
    pairs = a.unionByName(b).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return pairs.selectExpr(*[f"k{i} AS {quoted(k)}" for i, k in enumerate(keys)], f"inline({comparison(fields, names, unknown_left, values)})")


def comparison(fields: Sequence[str], names: tuple[str, str], unknown_left: bool, values: bool) -> str:
    """The SQL array of differences of one pair of structs ``l`` and ``r``."""
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    row = lambda name, x, y, hit: f"named_struct('difference', {name}, 'left_value', {x}, 'right_value', {y}, 'hit', {hit})"
    null = "cast(null AS string)"
    live_l, live_r = "(l IS NOT NULL AND NOT l.gone)", "(r IS NOT NULL AND NOT r.gone)"
    rows = [
        row(text(names[0]), null, null, f"{live_l} AND r IS NULL"),
        row(text(names[1]), null, null, f"{live_r} AND l IS NULL"),
        row("'deleted'", "cast(l.gone AS string)", "cast(r.gone AS string)", "l IS NOT NULL AND r IS NOT NULL AND l.gone <> r.gone"),
    ]
    for i, f in enumerate(fields):
        hit = f"{live_l} AND {live_r} AND NOT (l.f.f{i} <=> r.f.f{i})" + (f" AND l.f.f{i} IS NOT NULL" if unknown_left else "")
        rows.append(row(text(f), f"cast(l.f.f{i} AS string)", f"cast(r.f.f{i} AS string)", hit))
    kept = "named_struct('difference', d.difference" + (", 'left_value', d.left_value, 'right_value', d.right_value)" if values else ")")
    return f"transform(filter(array({', '.join(rows)}), d -> d.hit), d -> {kept})"
