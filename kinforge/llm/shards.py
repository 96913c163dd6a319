"""Question-and-answer exchange between document shards and hash parts.

Documents are dealt once, by a hash of the whole row, into shards of about ``SHARD_BYTES`` of text.  A shard sends each
hash part that it has keys for one packed row of its *distinct* keys, so a key that fills a third of the corpus reaches
a part at most once per shard.  The part answers every shard in the order of its question, and the answers meet the
shard's documents again.  Shards and parts grow with the input, parts PART_SHARDS times slower, and nothing is sent for
a part without keys: there are at most as many rows as distinct keys, and while the shuffle partitions are as many as
the parts, rows grow as the shards do.  No part or shard holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import relax, text_bytes
from .textkit import runs

SHARD_BYTES = 4 << 20  # of text
PART_SHARDS = 8
QUESTION = "shard int, part int, keys binary, values binary"
ANSWER = "shard int, part int, kind int, answer binary"


def deal(docs: DataFrame, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """doc_id, text, shard, and ``row``: a struct of all other columns, if there are any; and the numbers of shards and parts."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(least, -(-text_bytes(docs) // shard_bytes))
    parts = min(shards, max(least, -(-shards // PART_SHARDS)))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")] + ([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else [])
    return docs.select(*cols, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard")), shards, parts


def one(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    got = table.column(name).combine_chunks()
    return got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)


def pack(a: np.ndarray) -> bytes:
    """Its bytes by place (all first bytes, all second, ...), compressed: small or slowly growing numbers take little."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return len(a).to_bytes(4, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(blob[4:], n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def questions(shard: int, part: np.ndarray, keys: Callable[[int, int], bytes], values: Callable[[int, int], bytes]) -> pa.Table:
    """One row for every part that has keys; ``part`` is sorted, ``keys`` and ``values`` write a range of them."""
    first, _ = runs(part)
    ends = np.append(first[1:], len(part))
    cut = lambda f: pa.array([f(a, b) for a, b in zip(first, ends)], pa.binary())
    return pa.table([pa.array(np.full(len(first), shard, np.int32)), pa.array(part[first].astype(np.int32)), cut(keys), cut(values)], names=["shard", "part", "keys", "values"])


def answers(asked: pa.Table, kind: int, blobs: list[bytes]) -> pa.Table:
    """One answer to each row of ``asked``, in its order."""
    return pa.table([asked.column("shard"), asked.column("part"), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], names=["shard", "part", "kind", "answer"])


def pieces(lengths: list[int]) -> list[tuple[int, int]]:
    ends = np.cumsum(lengths).tolist()
    return [(b - n, b) for b, n in zip(ends, lengths)]


def ordered(replies: pa.Table, kind: int) -> list[bytes]:
    """The answers of one kind to a shard, in the order of the parts."""
    kinds, parts = one(replies, "kind").to_numpy(zero_copy_only=False), one(replies, "part").to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(kinds == kind)
    column = one(replies, "answer")
    return [column[int(i)].as_py() for i in rows[np.argsort(parts[rows], kind="stable")]]


def bits_in_order(replies: pa.Table, kind: int, part: np.ndarray) -> np.ndarray:
    """Bit answers of all parts, joined in the order of the sorted questions."""
    got = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)).astype(bool) for b, n in zip(ordered(replies, kind), runs(part)[1])]
    return np.concatenate(got) if got else np.zeros(0, bool)


def ask(dealt: DataFrame, send: Callable[[pa.Table], pa.Table], reply: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Questions of every shard, answered by every part: ANSWER rows."""
    return answer(dealt.groupBy("shard").applyInArrow(lambda docs: relax(send(docs)), QUESTION), reply)


def answer(asked: DataFrame, reply: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asked.groupBy("part").applyInArrow(lambda rows: relax(reply(rows)), ANSWER)


def meet(dealt: DataFrame, replies: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    return dealt.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(lambda docs, got: relax(finish(docs, got)), schema)
