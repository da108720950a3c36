"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the least hash of its inner s-mers stands at its first or last
s-mer; whether it is depends on the k-mer alone, so equal passages give equal anchors whatever surrounds them. The
fingerprint is all distinct syncmers (32 bits of their hashes), each with the byte position of its first occurrence, so
it grows with the text. Likeness counts the anchors that both fingerprints share and that stand in the same order in
both texts, over the anchors of either.

Cases: null text is empty; an empty text's fingerprint is empty and like only another empty one; a text of under K
bytes, or without syncmers, is one anchor as a whole; repeated rows and doc_ids are ordered by text as well; a null
doc_id comes last; an only document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_of, partitions, range_bounds, small_batches, table

K, S = 21, 6
#: Positions past this are written as it.
MAX_POS = 0xFFFFFFFF
#: Characters of fingerprints after which a batch is handed on; results do not depend on it.
OUT_CHARS = 1 << 24
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v * _M1
    v ^= v >> np.uint64(29)
    v *= _M2
    v ^= v >> np.uint64(32)
    return v


def _smers(data: np.ndarray) -> np.ndarray:
    """Hash of the S bytes at each place."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) - S + 1,), dtype="<u8", buffer=padded, strides=(1,))
    return _mixed(words & np.uint64((1 << 8 * S) - 1))


def syncmer_places(data: np.ndarray) -> np.ndarray:
    """Starts of the closed syncmers of a byte array of at least K bytes."""
    h = _smers(data)
    w, least, span = K - S + 1, h, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(h) - w + 1], least[w - span :])
    return np.flatnonzero((h[: len(least)] == least) | (h[w - 1 :] == least))


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes in rising order, and their first byte positions."""
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)
    places = syncmer_places(data) if len(data) >= K else np.zeros(0, np.int64)
    if not len(places):
        return np.array([int.from_bytes(hashlib.sha256(raw).digest()[:4], "little")], np.uint64), np.zeros(1, np.int64)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    h = np.zeros(len(places), np.uint64)
    for at in (0, 8, K - 8):
        h = _mixed((h ^ words[places + at]) * _M3)
    h >>= np.uint64(32)
    u, first = np.unique(h, return_index=True)
    return u, places[first]


def to_string(hashes: np.ndarray, places: np.ndarray) -> str:
    """16 hexadecimal digits an anchor: its hash, then its position."""
    packed = np.stack([hashes, np.minimum(places, MAX_POS).astype(np.uint64)], axis=1).astype(">u4")
    return packed.tobytes().hex()


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").reshape(-1, 2)
    return packed[:, 0].astype(np.uint64), packed[:, 1].astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: shared anchors in the same order, over the anchors of both together."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    ia = np.flatnonzero(b[0][at] == a[0])
    ib = at[ia]
    if not len(ia):
        return 0.0
    n = len(a[0]) + len(b[0]) - len(ia)
    pa_, pb = np.minimum(a[1][ia], MAX_POS), np.minimum(b[1][ib], MAX_POS)
    tails: list[int] = []
    for p in pb[np.lexsort((pb, pa_))].tolist():
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    return len(tails) / n


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches):
    """Rows in order; each is finished when the next, or the copy of the next bucket's first, has come."""

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)] if out else [pa.array([], t) for t in _OUT.types], schema=_OUT)

    last = None
    for batch in batches:
        out, chars = [], 0
        for doc_id, text, sentinel in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("sentinel").to_pylist(), strict=True):
            text = text or ""
            marks = anchors(text.encode())
            if last is not None:
                own_id, own, own_marks = last
                cut = len(own) // 3
                edited = (own[: len(own) - cut] + text[:cut]).encode()
                edited_marks = anchors(edited)
                out.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), to_string(*own_marks), to_string(*edited_marks), likeness(own_marks, edited_marks), likeness(own_marks, marks)))
                chars += len(out[-1][3]) + len(out[-1][4])
                if chars > OUT_CHARS:
                    yield packed(out)
                    out, chars = [], 0
            last = None if sentinel else (doc_id, text, marks)
        yield packed(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and their likenesses to it and to the next.

    The next document is that of the next lower doc_id, after the last the first. Ranges of doc_id are the tasks; each
    gets a copy of the next range's first row, so there is one shuffle of the texts and none of pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", -F.coalesce(F.col("doc_id"), F.lit(-(1 << 63) + 1)))
    rows = rows.withColumn("bucket", bucket_of("key", range_bounds(rows.where("doc_id is not null"), "key", n)))
    first = {r["bucket"]: r["key"] for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect()}  # one row a range
    if not first:
        return spark.createDataFrame([], _DDL)
    order = sorted(first)
    before = {first[b]: order[i - 1] for i, b in enumerate(order)}
    heads = rows.where(F.col("key").isin(list(before)))
    heads = heads.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("text"))).where("nth = 1").drop("nth")
    to = spark.createDataFrame(list(before.items()), "key long, to int")
    heads = heads.join(F.broadcast(to), "key").select("doc_id", "text", "key", F.col("to").alias("bucket"))
    dealt = rows.withColumn("sentinel", F.lit(False)).unionByName(heads.withColumn("sentinel", F.lit(True)))
    dealt = dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "sentinel", "key", "text")
    return dealt.select("doc_id", "text", "sentinel").mapInArrow(_walk, _DDL)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
