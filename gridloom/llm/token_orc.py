"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, one file per range in ascending order, so stripes carry tight doc_id
statistics: readers prune stripes by them, by row-index strides and by the Bloom filter, and read stripes in parallel.

Cases: null text is empty and yields the end id alone; null doc_id sorts first; repeated doc_ids keep all their rows,
ordered by a hash of the text; an empty table gives empty files' worth of rows (none); other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, input_bytes, partitions, shared_path, small_batches, split_words, sums, table

END_ID = 0
#: Chunks of a Python worker's table, which then keeps the KEPT used most, and ids of chunks, beyond which it starts
#: anew; results do not depend on it.
CACHE_CHUNKS, KEPT, CACHE_IDS = 450_000, 120_000, 1 << 23
#: Bytes of texts encoded together, and chunks given to the library in a call; results depend on neither.
GROUP_BYTES, JOINED = 12 << 20, 4096
#: Bytes of text for a file and its task.
FILE_BYTES, MAX_FILES = 256 << 20, 1 << 19
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
MIN_LONG = -(1 << 63)
#: Places before spaces but those between white space, where a cut could part a run that the tokenizer keeps whole.
CUT = re.compile(r"(?<!\s)(?= )|(?= (?!\s))")


def joined(strings: pa.Array) -> str:
    """The strings one after another, as they lie in the array."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :]
    return str(memoryview(strings.buffers()[2])[ends[0] : ends[len(strings)]], "utf-8")


def ascii_tails(strings: pa.Array, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(tails, number of each string's tail): the last bytes, so many, of each string, all printable ASCII. Tails of up
    to eight bytes come once."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][1 : len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8)
    keys = np.zeros(len(strings), np.uint64)
    for j in range(min(8, int(sizes.max()))):
        at = np.flatnonzero(sizes > j)
        keys[at] |= data[ends[at] - 1 - j].astype(np.uint64) << np.uint64(8 * j)
    long = np.flatnonzero(sizes > 8)
    keys[long] = 0
    distinct, which = np.unique(keys, return_inverse=True)
    tails = [int(k).to_bytes(8, "big").lstrip(b"\0").decode() for k in distinct]
    for i in long.tolist():
        tails.append(bytes(data[ends[i] - sizes[i] : ends[i]]).decode())
        which[i] = len(tails) - 1
    return tails, which


class ChunkEncoder:
    """Byte-level BPE through the tokenizers library.

    The pre-tokenizer always cuts before a space that has no white space on both sides, and merges never cross such a
    cut, so a text's ids are those of its chunks, and a chunk's are those of its parts; each distinct part is encoded by
    the library once. Texts that hold an added token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # a byte-level token has a character a byte
        for token, i in vocab.items():
            self.lengths[i] = len(token)
        self.table, self.tails = WordTable(), {}

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[1]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids); null is empty."""
        if self.table.lists.used > CACHE_IDS:
            self.table, self.tails = WordTable(), {}
        elif len(self.table) > CACHE_CHUNKS:
            self.table.shrink(KEPT)
            self.tails = {}
        texts = pc.fill_null(texts, "")
        offsets, codes, words = split_words(texts)
        offsets = offsets.astype(np.int64)
        odd = self._odd(offsets, codes, words)
        if odd.any():
            codes = codes[np.repeat(~odd, np.diff(offsets))]
            offsets = np.cumsum(np.concatenate([[0], np.diff(offsets)[~odd]]))
        counts, ids = self._plain(offsets, codes, words)
        if not odd.any():
            return counts, ids
        every = np.zeros(len(texts), np.int64)
        every[~odd] = counts
        plain, ends, parts = np.flatnonzero(~odd), np.cumsum(counts), [ids[:0]] * len(texts)
        for i, a, b in zip(plain.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            parts[i] = ids[a:b]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            parts[i] = self.whole(text) if self.added and self.added.search(text) else self._in_parts(CUT.split(text))
            every[i] = len(parts[i])
        return every, np.concatenate(parts)

    def _odd(self, offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> np.ndarray:
        """Texts, given by their words, with a space between white space, where a cut before the space could part a run
        that the tokenizer keeps whole, or with an added token (which has no space)."""
        flags = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        empty = flags(pc.equal(pc.binary_length(words), 0))
        white = [flags(pc.utf8_is_space(pc.utf8_slice_codeunits(words, *at))) for at in ((0, 1), (-1,))]
        begins, ends = (empty | w for w in white)
        held = flags(pc.match_substring_regex(words, self.added.pattern)) if self.added else empty & False
        if not (begins.any() or held.any()):
            return np.zeros(len(offsets) - 1, dtype=bool)
        # The space between word i - 1 and word i of a text; an empty first or last word is no white space.
        before, after = ends[codes[:-1]], begins[codes[1:]]
        inner = np.zeros(len(codes), dtype=bool)
        inner[1:] = before & after
        inner[offsets[:-1]] = False
        first, last, none = offsets[:-1], offsets[1:] - 1, empty[codes]
        second = first[first < last] + 1
        inner[second] &= ~none[second - 1]
        closing = last[first < last]
        inner[closing] &= ~none[closing]
        return sums((inner | held[codes]).astype(np.int64), offsets) > 0

    def _plain(self, offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode_all of texts, given by their words, that can be cut before every space."""
        if not len(codes):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int32)
        first = words.take(pa.array(codes[offsets[:-1]])).dictionary_encode()
        spaced = pc.binary_join_element_wise(" ", words, "")
        every = self.numbers(pa.concat_arrays([spaced, first.dictionary]))
        numbers = every[codes]
        numbers[offsets[:-1]] = every[len(words) :][first.indices.to_numpy()]
        self.table.used(numbers)
        lengths, ids = self.table.gather(numbers)
        return sums(lengths, offsets), ids

    def _in_parts(self, chunks: list[str]) -> np.ndarray:
        coded = pa.array(chunks, pa.string()).dictionary_encode()
        return self.table.gather(self.numbers(coded.dictionary)[coded.indices.to_numpy()])[1]

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        """The distinct chunks' numbers in the table; new ones are learned."""
        out = self.table.find(chunks)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.learn(chunks.take(pa.array(new)))
        return out

    def learn(self, chunks: pa.Array) -> np.ndarray:
        """Put new chunks in the table, by their parts: the pre-tokenizer cuts in any case at single line ends, and after
        letters that only ASCII punctuation follows up to the end of a line. Chunks with other white space are encoded
        whole."""
        out = np.zeros(len(chunks), np.int64)
        lines = pc.split_pattern(chunks, "\n")
        odd = pc.or_(pc.invert(pc.utf8_is_printable(lines.values)), pc.or_(pc.ends_with(lines.values, " "), pc.equal(pc.binary_length(lines.values), 0)))
        odd = sums(odd.to_numpy(zero_copy_only=False).astype(np.int64), lines.offsets.to_numpy()) > 0
        if odd.any():
            out[odd] = self.encode_parts(chunks.filter(pa.array(odd)))
        rest = np.flatnonzero(~odd)
        if not len(rest):
            return out
        own = chunks.take(pa.array(rest))
        lines = pc.split_pattern(own, "\n")
        offsets, lines = lines.offsets.to_numpy().astype(np.int64), lines.values
        stems = pc.utf8_rtrim(lines, characters=punctuation)
        cut = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(lines)), pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, -1)))
        sizes = pc.subtract(pc.binary_length(lines), pc.binary_length(stems)).to_numpy()
        stems = pc.if_else(cut, stems, lines).dictionary_encode()
        parts = np.zeros((len(lines), 3), np.int64)  # the stem, its punctuation and the line's end; 0 is empty
        parts[:, 0] = self._parts(stems.dictionary)[stems.indices.to_numpy()]
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        if len(at):
            tails, which = ascii_tails(lines.take(pa.array(at)), sizes[at])
            parts[at, 1] = self._tails(tails)[which]
        ends = np.ones(len(lines), dtype=bool)
        ends[offsets[1:] - 1] = False
        if ends.any():
            parts[ends, 2] = self._tails(["\n"])[0]
        several = np.diff(offsets) > 1
        several |= parts[offsets[:-1], 1] > 0
        single = np.flatnonzero(~several)
        out[rest[single]] = parts[offsets[single], 0]
        if several.any():
            of_row = np.repeat(several, np.diff(offsets))
            lengths, ids = self.table.gather(parts[of_row].ravel())
            rows = 3 * np.cumsum(np.concatenate([[0], np.diff(offsets)[several]]))
            out[rest[several]] = self.table.add(own.filter(pa.array(several)), sums(lengths, rows), ids)
        return out

    def _tails(self, tails: list[str]) -> np.ndarray:
        """Numbers of a few distinct punctuations."""
        new = [t for t in set(tails) if t and t not in self.tails]
        if new:
            self.tails.update(zip(new, self._parts(pa.array(new)).tolist(), strict=True))
        return np.array([self.tails[t] if t else 0 for t in tails], dtype=np.int64)

    def _parts(self, parts: pa.Array) -> np.ndarray:
        out = self.table.find(parts)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.encode_parts(parts.take(pa.array(new)))
        return out

    def encode_parts(self, parts: pa.Array) -> np.ndarray:
        """Encode new parts by the library: many in one text if that cannot change them, and its ids parted by their
        bytes."""
        out = np.zeros(len(parts), np.int64)
        spaced = pc.starts_with(parts, " ")
        inner = pc.if_else(spaced, pc.utf8_ltrim(parts, characters=" "), parts)
        plain = pc.and_(pc.and_(pc.utf8_is_printable(parts), pc.invert(pc.match_substring(inner, " "))), pc.less_equal(pc.subtract(pc.binary_length(parts), pc.binary_length(inner)), 1))
        plain = pc.and_(plain, pc.greater(pc.binary_length(inner), 0))
        for mask, gap in ((pc.and_(plain, spaced), ""), (pc.and_(plain, pc.invert(spaced)), "\n")):
            every = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            for at in range(0, len(every), JOINED):
                places = every[at : at + JOINED]
                part = parts.take(pa.array(places))
                text = joined(pc.binary_join_element_wise(part, "", gap) if gap else part)
                ids = np.asarray(self.tokenizer.encode_batch_fast([text[: len(text) - len(gap)]], add_special_tokens=False)[0].ids, dtype=np.int32)
                sizes = pc.binary_length(part).to_numpy().astype(np.int64)
                stops = np.cumsum(sizes + len(gap)) - len(gap)
                ends = np.cumsum(self.lengths[ids])
                last = np.searchsorted(ends, stops) + 1
                first = np.searchsorted(ends, stops - sizes, side="right")
                inside = np.ones(len(ids), dtype=bool)
                if gap:
                    inside[last[:-1]] = False
                out[places] = self.table.add(part, last - first, ids[inside])
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for at in range(0, len(other), JOINED):
            places = other[at : at + JOINED]
            part = parts.take(pa.array(places))
            ids = [np.asarray(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            out[places] = self.table.add(part, np.array(list(map(len, ids))), np.concatenate(ids))
        return out


@lru_cache(maxsize=1)
def _chunk_encoder(path: str) -> ChunkEncoder:
    """A Python worker's encoder, with its cache, which its next tasks use again."""
    return ChunkEncoder(path)


def _encoder(path: str):
    """A task's rows in order, all of one block."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("block_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder, start, held, size = _chunk_encoder(path), 0, [], 0

        def packed(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal start
            rows = pa.Table.from_batches(group).combine_chunks()
            doc_id, block, text = (rows.column(c).chunk(0) for c in ("doc_id", "block", "text"))
            counts, ids = encoder.encode_all(text)
            values = np.full(len(ids) + len(counts), END_ID, dtype=np.int32)
            values[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            counts = counts + 1
            ends = np.cumsum(counts)
            starts, start = start + ends - counts, start + int(ends[-1])
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            return pa.RecordBatch.from_arrays([doc_id, block, pa.array(starts), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > GROUP_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write (doc_id, block, block_start, n_tokens, ids) as ORC, files (blocks) and rows in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("key", F.coalesce("doc_id", F.lit(MIN_LONG)))
    n = max(partitions(spark), min(-(-input_bytes(docs) // FILE_BYTES), MAX_FILES))
    dealt = keyed.repartitionByRange(n, "key").sortWithinPartitions("key", F.xxhash64("text"))
    out = dealt.select("doc_id", F.spark_partition_id().alias("block"), "text").mapInArrow(_encoder(tokenizer_path), "doc_id long, block int, block_start long, n_tokens long, ids array<int>")
    out.write.options(**ORC_OPTIONS).orc(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, block int, block_start long, n_tokens long, ids array<int>").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before, in file order."""
    rows = _blocks(spark, path)
    sizes = sorted((r["block"], r["n"]) for r in rows.groupBy("block").agg(F.sum("n_tokens").alias("n")).collect())  # one row a file
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(b, x) for (b, _), x in zip(sizes, before, strict=False)], "block int, before long")
    rows = rows.join(F.broadcast(offsets), "block")  # MAX_FILES rows at most
    return rows.select("doc_id", (F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents: stripes and row groups that cannot hold them, by their statistics and
    Bloom filters, are not read."""
    return _blocks(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksums(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
        crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], schema=schema)


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the rows of read_tokens."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "op3-tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(read_tokens(spark, path))
