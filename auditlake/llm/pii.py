"""Personal information in free text: found with a semi-Markov conditional random field, replaced by typed placeholders.

The driver trains the model once per call on a bounded sample of labelled sentences made from a seed
(:mod:`auditlake.llm.pii_samples`) and ships its weights to the tasks. Texts are spread evenly over the tasks, as the work on
them outweighs their transport, and are read in one pass. They are cut into independent groups of neighbouring candidates, so a long text costs time in
proportion to its length.
"""

from __future__ import annotations

import gc
import random
import uuid
from collections import Counter
from collections.abc import Hashable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from auditlake.llm.pii_samples import LANGUAGES, Maker
from auditlake.llm.pii_segments import KINDS, Lexicon, expand, segments
from auditlake.llm.semicrf import SemiCRF
from auditlake.session import ship, spread

#: Labelled texts the model is trained on, and passes over them.
SAMPLES, EPOCHS, SEED = 8000, 4, 20240
#: Texts a feature must occur in to be used, and the shares of texts trained whole, without context, without words, without both.
RARE, WITHHELD = 4, (45, 20, 10, 25)
#: Most name parts the lexicon may have: it is sent to every task.
MAX_LEXICON = 100_000

Rows = tuple[tuple[str | None, str | None], ...]


@lru_cache(maxsize=4)
def trained(rows: Rows, samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = SEED, part: str = "all", languages: tuple[str, ...] = LANGUAGES) -> dict[Hashable, float]:
    """Weights for a lexicon of (part, kind) rows; the same for the same arguments.

    Of some texts the context, of some the words, of some both are withheld, so that form and lexicon alone are weighed
    rightly where the surroundings are unknown; features seen in fewer than ``RARE`` texts are left out.
    """
    lexicon = Lexicon(list(rows))
    maker = Maker(lexicon, seed, part, languages)
    data, seen, r = [], Counter(), random.Random(seed)
    for _ in range(samples):
        text, gold = maker.text()
        without = r.choices(((), ("c",), ("w",), ("c", "w")), WITHHELD)[0]
        found = segments(text, lexicon)
        for s in found:
            s.features = [f for g in s.features if g[0] not in without for f in expand(g)]
        seen.update({f for s in found for f in s.features})
        data.append(("\0" * len(text) if "c" in without else text, found, set(gold)))  # neighbours are context too
    for _, found, _ in data:
        for s in found:
            s.features = [f for f in s.features if seen[f] >= RARE]
    model = SemiCRF()
    model.fit(data, epochs)
    return {f: round(w, 4) for f, w in model.weights.items() if abs(w) > 1e-3}


def lexicon_rows(lexicon: DataFrame, part: str = "name_part", kind: str = "part_kind") -> Rows:
    """The lexicon on the driver; it is a fixed table, and refused if it is not small."""
    rows = lexicon.select(part, kind).distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"a lexicon has at most {MAX_LEXICON} parts")
    return tuple(sorted(((r[0], r[1]) for r in rows), key=repr))


def entities(text: str, lexicon: Lexicon, model: SemiCRF) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a text, in order, in code points."""
    return [(s.start, s.end, s.kind) for s in model.decode(segments(text, lexicon), text)]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


_at_hand: dict[str, tuple[SemiCRF, Lexicon]] = {}


def _ready(name: str, weights: dict[Hashable, float], parts: Rows) -> tuple[SemiCRF, Lexicon]:
    """The model and lexicon of a call, made once per Python worker, with what they remember from task to task."""
    if name not in _at_hand:
        _at_hand.clear()
        _at_hand[name] = SemiCRF(weights, expand), Lexicon(list(parts))
        gc.freeze()  # they stay; the collector need not look at them again
        gc.set_threshold(50_000, 20, 20)  # nor so often at candidates, which hold no cycles
    return _at_hand[name]


def find(df: DataFrame, row: Column, text: Column, lexicon: Rows, replace: bool = False) -> DataFrame:
    """``row``, ``kind``, ``start_pos``, ``end_pos`` of every item; with ``replace`` instead ``row``, ``text`` of every row.

    Items of one text never overlap. A null text has no items and stays null; an empty or blank one stays as it is.
    Repeated rows are answered each. With an empty lexicon names are found by form and context alone.
    """
    ship(df.sparkSession)
    rows = df.select(row.alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    weights = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, trained(lexicon), lexicon))  # some ten thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lex = _ready(*weights.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [entities(t, lex, model) if t else [] for t in texts]
            if replace:
                done = [None if t is None else redacted(t, f) for t, f in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(done, pa.string())], ["row", "text"])
            else:
                at = [i for i, f in enumerate(found) for _ in f]
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(at, pa.int64())), pa.array([x[2] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())],
                    ["row", "kind", "start_pos", "end_pos"],
                )

    return spread(rows).mapInArrow(run, f"row {kind}, text string" if replace else f"row {kind}, kind string, start_pos long, end_pos long")


__all__ = ["KINDS", "entities", "find", "lexicon_rows", "redacted", "trained"]
