"""Encoding of a whole corpus with a public byte-level BPE (problem 8).

Texts of up to ``CHUNK`` characters are encoded as they are. Longer ones are
cut into overlapping chunks that are pre-tokenised in parallel. A chunk that
starts inside a pre-token finds its first boundaries wrong, but as soon as it
shares a boundary with the chunk before, both agree for good (the pattern
looks at nothing to the left of a boundary): there the two are stitched. The
pieces between stitches are encoded in parallel and their ids joined. Where an
overlap holds no common boundary (a pre-token longer than the overlap), the
chunks are encoded as one piece, so the result is always that of the whole text.
Decoding concatenates the tokens' raw bytes.

Defined results: the empty list for a null and for an empty text; the strings
of special tokens are ordinary text; repeated ids give a row each; lone
surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK = 8192
OVERLAP = 256
#: A boundary this near a chunk's end may still move when more text follows.
MARGIN = 8


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _pre_token() -> regex.Pattern:
    return regex.compile(PATTERN)


def _encode_column(texts: pa.Array, path: str) -> pa.ListArray:
    """Ids of each text; null and empty give the empty list."""
    enc = encoder(path)
    empty = np.empty(0, np.int32)
    found = [enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32) if t else empty for t in texts.to_pylist()]
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([empty, *found])))


def _encode(batches: Iterator[pa.RecordBatch], path: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Replace the last column, a text, by its ids."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _encode_column(b.columns[-1], path)], [*b.schema.names[:-1], "ids"])


def _split(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(row, chunk_no, text) of overlapping chunks of each long text."""
    step = chunk - overlap
    for b in batches:
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            starts = range(0, max(1, len(text) - overlap), step)
            for at in range(0, len(starts), 64):
                part = starts[at : at + 64]
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(part), pa.int64()), "chunk_no": pa.array(range(at, at + len(part)), pa.int32()), "text": [text[s : s + chunk] for s in part]})


def _boundaries(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(row, chunk_no, head, tail, plain): pre-token starts within the overlaps, as offsets from the overlap's start.

    ``plain`` are those of the tail where white space follows another character:
    no pre-token has both in that order, so they are boundaries of any reading.
    """
    pattern, step = _pre_token(), chunk - overlap
    lists = pa.list_(pa.int32())
    for b in batches:
        heads, tails, plains = [], [], []
        for text in b.column(2).to_pylist():
            starts = [m.start() for m in pattern.finditer(text)]
            sure = len(text) - MARGIN
            heads.append([s for s in starts if s < overlap and s <= sure])
            # After white space the pattern looks ahead, past the end of a piece that ended there.
            tails.append([s - step for s in starts if step <= s <= sure and not text[s - 1].isspace()])
            plains.append([s for s in tails[-1] if text[s + step] in " \t\r\n"])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, lists) for x in (heads, tails, plains)]], ["row", "chunk_no", "head", "tail", "plain"])


def _stitches(pdf):
    """Per chunk of one text: its piece, and the part of it [start, stop) that belongs there.

    A text of n characters has n / CHUNK rows of a few numbers here. A chunk
    that found no boundary in common with the one before may still be out of
    step in its tail, so there only plain boundaries are taken.
    """
    import pandas as pd

    pdf = pdf.sort_values("chunk_no")
    out, piece, start = [], 0, 0
    heads, tails, plains = (list(map(set, pdf[c])) for c in ("head", "tail", "plain"))
    syncs: list[int | None] = [0]
    for i in range(1, len(pdf)):
        common = heads[i] & (tails[i - 1] if syncs[-1] is not None else plains[i - 1])
        syncs.append(min(common, default=None))
    syncs.append(None)
    last = len(pdf) - 1
    for i, (row, no, step) in enumerate(zip(pdf["row"], pdf["chunk_no"], pdf["step"])):
        sync = syncs[i + 1]
        if i == last:
            out.append((row, no, piece, start, 2**31 - 1))
        elif sync is None:
            out.append((row, no, piece, start, step))
            start = 0
        else:
            out.append((row, no, piece, start, step + sync))
            piece, start = piece + 1, sync
    return pd.DataFrame(out, columns=["row", "chunk_no", "piece", "start", "stop"])


def _encode_long(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) of texts longer than a chunk."""
    chunks = materialize(long.mapInArrow(lambda it: _split(it, chunk, overlap), "row long, chunk_no int, text string"), "chunks")
    spread = chunks.repartition(F.col("row"), F.col("chunk_no"))
    edges = spread.mapInArrow(lambda it: _boundaries(it, chunk, overlap), "row long, chunk_no int, head array<int>, tail array<int>, plain array<int>")
    edges = edges.withColumn("step", F.lit(chunk - overlap))
    parts = edges.groupBy("row").applyInPandas(_stitches, "row long, chunk_no int, piece int, start int, stop int")
    placed = chunks.join(parts, ["row", "chunk_no"])
    cut = placed.select("row", "piece", "chunk_no", F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")).alias("part"))
    pieces = cut.groupBy("row", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))), lambda x: x["part"]), "").alias("text"))
    encoded = pieces.mapInArrow(lambda it: _encode(it, path), "row long, piece int, ids array<int>")
    joined = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return joined.select("row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def encode_corpus(docs: DataFrame, key: str, text: str, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of every row of ``docs``; ``key`` is any column."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = rows.where(~is_long).mapInArrow(lambda it: _encode(it, path), f"key {kind}, ids array<int>")
    # Keys may repeat, so long texts are numbered; written once, the numbers stay the same when read again.
    long = materialize(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    ids = _encode_long(long.select("row", "text"), path, chunk, overlap)
    return short.unionByName(long.select("row", "key").join(ids, "row").select("key", "ids")).withColumnRenamed("key", key)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = {v: k for k, v in ranks(path).items()}
    for b in batches:
        texts = [b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])


def decode_corpus(encoded: DataFrame, key: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of the ids' concatenated bytes."""
    rows = encoded.select(F.col(key).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _decode(it, path), f"key {kind}, text string").withColumnRenamed("key", key)
