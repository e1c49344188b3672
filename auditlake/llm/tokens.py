"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts up to ``chunk`` code points are encoded where they are read, without a shuffle. Longer ones are cut into overlapping
chunks that are pre-tokenised in parallel; where the pre-token boundaries of two neighbours agree inside their overlap the
text is cut, and the pieces between cuts are encoded in parallel and put together again. A pair of chunks without a common
boundary (a run of one character class longer than the overlap) is not cut there, so the ids always equal those of the whole
text. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.session import ship, spread, work_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits text before merging (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 8192, 512
#: The largest vocabulary file that is sent to executors.
MAX_VOCABULARY = 64 << 20
#: A boundary this close to a chunk's end may depend on what follows.
EDGE = 4
_pattern = regex.compile(PATTERN)

_loaded: dict[str, object] = {}


def ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def encoder(vocabulary: str | bytes = VOCABULARY):
    """The tiktoken encoder of a rank file (its path or content); made once per Python worker."""
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _loaded:
        import tiktoken

        _loaded[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})
    return _loaded[name]


def shipped(spark: SparkSession, vocabulary: str) -> Broadcast[bytes]:
    """The rank file, read on the driver and sent to the executors, which need not have it; refused above ``MAX_VOCABULARY`` bytes."""
    with open(vocabulary, "rb") as f:
        content = f.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary has at most {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(content)


def safe_boundaries(text: str, low: int, high: int) -> list[int]:
    """Pre-token boundaries b of ``text`` with low <= b < high that hold wherever the scan began.

    A pre-token is a run of one class (letters, digits, others, white space), but for a leading blank and for
    contractions, so a boundary behind a visible character whose class ends there is one for every scan. Boundaries
    between letters (behind a contraction), behind an apostrophe, or behind white space are left out.
    """
    out = []
    for m in _pattern.finditer(text, max(0, low - EDGE)):
        b = m.end()
        if b >= high or b >= len(text):
            break
        if b >= low and not text[b - 1].isspace() and text[b - 1] != "'" and not (text[b - 1].isalpha() and text[b].isalpha()):
            out.append(b)
    return out


def _encode(vocabulary: Broadcast[bytes], lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for b in batches:
            names = [n for n in b.schema.names if n != "text"]
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column("text").to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], out], [*names, "ids"])

    return run


def _chunked(chunk: int, overlap: int):
    """Texts cut into overlapping chunks, one after the other: each text is gone through once."""
    names = ["uid", "start", "size", "text", "stride", "overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = chunk - overlap
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                starts = range(0, len(text) - overlap, stride)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("uid").take(pa.array([i] * n)), pa.array(starts, pa.int64()), pa.array([len(text)] * n, pa.int64()), pa.array([text[x : x + chunk] for x in starts], pa.string()), pa.array([stride] * n, pa.int64()), pa.array([overlap] * n, pa.int64())], names
                )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut at their ``cuts`` into numbered pieces."""
    for b in batches:
        for i, (text, cuts) in enumerate(zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True)):
            edges = [0, *cuts, len(text)]
            n = len(edges) - 1
            at = pa.array([i] * n)
            yield pa.RecordBatch.from_arrays([b.column("uid").take(at), b.column("row").take(at), pa.array(range(n), pa.int32()), pa.array([text[x:y] for x, y in zip(edges, edges[1:], strict=False)], pa.string())], ["uid", "row", "n", "text"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks (uid, start, size, stride, overlap, text): the boundaries in the first overlap and in the last.

    Only the overlaps are pre-tokenised here; what lies between is, when its piece is encoded.
    """
    for b in batches:
        heads, tails = [], []
        for start, text, size, stride, overlap in zip(*(b.column(c).to_pylist() for c in ("start", "text", "size", "stride", "overlap")), strict=True):
            # The last characters may be the beginning of a pre-token that goes on behind the chunk.
            end = len(text) if start + len(text) >= size else len(text) - EDGE
            heads.append([x + start for x in safe_boundaries(text, 1, min(overlap, end))] if start else [])
            tails.append([x + start for x in safe_boundaries(text, stride, end)])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("start"), pa.array(heads, kind), pa.array(tails, kind)], ["uid", "start", "head", "tail"])


def token_ids(
    df: DataFrame, row: Column, text: Column, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, lengths_only: bool = False
) -> DataFrame:
    """``row`` and ``ids`` (array of int; with ``lengths_only`` their number) of every row, repeated rows included.

    A null or empty text has the empty array. No special tokens: their strings in a text are ordinary text. A null
    ``row`` stays null. The order of the rows is not kept.
    """
    if not EDGE < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    spark: SparkSession = df.sparkSession
    ship(spark)
    rows = df.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    kind = "bigint" if lengths_only else "array<int>"
    sent = shipped(spark, vocabulary)
    row_type = rows.schema["row"].dataType.simpleString()
    short = spread(rows.filter(F.length("text") <= chunk)).mapInArrow(_encode(sent, lengths_only), f"row {row_type}, ids {kind}")

    # Long texts are written, so that a file and a position name each of them, repeated rows too.
    path = work_dir(spark, "long-texts")
    rows.filter(F.length("text") > chunk).write.parquet(path)
    uid = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("p"))
    long = spark.read.parquet(path).select("row", "text", uid.alias("uid"))
    place = "uid struct<f:string,p:bigint>"
    chunks = long.select("uid", "text").mapInArrow(_chunked(chunk, overlap), f"{place}, start bigint, size bigint, text string, stride bigint, overlap bigint")
    scanned = chunks.repartition("uid", "start").mapInArrow(_scan, "uid struct<f:string,p:bigint>, start bigint, head array<bigint>, tail array<bigint>")
    common = F.array_min(F.array_intersect(F.lag("tail").over(Window.partitionBy("uid").orderBy("start")), F.col("head")))
    cuts = scanned.select("uid", common.alias("cut")).groupBy("uid").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    pieces = long.join(cuts, "uid").select("uid", "row", "text", "cuts").mapInArrow(_pieces, f"{place}, row {row_type}, n int, text string")
    encoded = pieces.repartition("uid", "n").mapInArrow(_encode(sent, lengths_only), f"uid struct<f:string,p:bigint>, row {row_type}, n int, ids {kind}")
    if lengths_only:
        joined = encoded.groupBy("uid", "row").agg(F.sum("ids").alias("ids"))
    else:
        joined = encoded.groupBy("uid", "row").agg(F.expr("flatten(transform(array_sort(collect_list(struct(n, ids))), x -> x.ids))").alias("ids"))
    return short.unionByName(joined.select("row", "ids"))


def decode(df: DataFrame, row: Column, ids: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """``row`` and ``text``: the tokens' bytes, concatenated and read as UTF-8. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    ship(df.sparkSession)
    sent = shipped(df.sparkSession, vocabulary)
    rows = df.select(row.alias("row"), ids.alias("ids"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
