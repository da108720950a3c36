"""MinHash near-duplicate detection: banded minima, signature verification, exact confirmation, star components.

A document's set holds its distinct shingles of K lower-cased words (64-bit hashes; with fewer words, the sequence as
one). MINIMA universal hashes give minima, cut into bands; documents of equal sets are first folded into one
representative, so copies never meet again. In every band's bucket each member is paired with the bucket's smallest id;
a pair must agree in its signatures (one bit a minimum), then in its full sets: 100 * intersection >= 80 * union. The
links' components come from alternating large-star and small-star. Buckets that then still hold several components have
their members of different components compared, so no link between different texts that any band found is lost: first by
signature and by an upper bound of their intersection, which leaves out shingles that no other such document has and
those whose place in the other's bitmap is empty; what passes is confirmed on full sets as well. The bound never lies
under the true intersection, so it drops no link, and it keeps the pairs of a group of near copies from being emitted.
Members meet only within neighbouring classes of set size, as sizes that differ by over a quarter cannot be linked, and
the members of a larger bucket are dealt to tiles of TILE, each of which meets all others in a task of its own. A pair at
a similarity of exactly 0.8 escapes all BANDS bands with a probability of 6e-7.

Cases: without words or text a set is empty and linked with nothing; rows that share a doc_id are linked; rows without
one take no part (component null, kept); repeated rows are equal sets; ties go to the smaller doc_id; an empty table
gives an empty result; other columns are ignored, and stay in drop_duplicates().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, let_go, own_name, small_batches, table, written

BANDS, ROWS = 36, 5
MINIMA = BANDS * ROWS
#: Members of a random cell of a larger bucket.
CELL = 16
#: Members of a bucket's tile in the residual comparison; results do not depend on it.
TILE = 2048
#: Longs of a bitmap of shingles, and shingles that a task holds before it hands on what it has.
BITMAP, HELD = 16, 1 << 20
#: Differing bits of two signatures, at most: 5.5 standard deviations beyond the mean at similarity 0.8.
MAX_BITS = 40
_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
_C = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> _U(27))) * _U(0x94D049BB133111EB)
    return v ^ (v >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << n.bit_length()
            for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = _Powers()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of k words."""
    data = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    _POWERS.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * _POWERS.up[: len(data)])])
    words = _mix((sums[ends] - sums[starts]) * _POWERS.down[starts])
    if len(words) < k:
        return _mix(np.sum(words * _C[: len(words)], keepdims=True, dtype=np.uint64) + _U(len(words)))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _C[i]
    return np.unique(_mix(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, (_A[:, None] * hashes[None, a : a + 512] + _B[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = _mix(least).reshape(BANDS, ROWS)
    return _mix((rows * _C[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C[60]).view(np.int64)


def bits(least: np.ndarray) -> np.ndarray:
    """One bit a minimum, as three longs."""
    one = (_mix(least) >> _U(17)).astype(np.uint8) & 1
    return np.packbits(np.concatenate([one, np.zeros(192 - MINIMA, np.uint8)])).view("<i8")


def jaccard_at_least(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and 100 * both >= 80 * (len(a) + len(b) - both)


_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
_SIG_DDL = "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, s0 long, s1 long, s2 long"


def _signatures(k: int):
    def run(batches):
        let_go()
        for batch in batches:
            n, sums, keys, sigs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                sums.append((np.sum(s, dtype=np.uint64), np.sum(_mix(s ^ _C[61]), dtype=np.uint64)))
                least = minima(s)
                keys.append(band_keys(least))
                sigs.append(bits(least))
            if not n:
                continue
            sums, sigs = np.array(sums, dtype=np.uint64).view(np.int64), np.array(sigs, dtype=np.int64)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys))), *(pa.array(sigs[:, i]) for i in range(3))], schema=_SIG)

    return run


def _confirm(k: int):
    """Of (a, b, text_a, text_b), sorted by a within the task, the pairs whose full sets are alike enough."""

    def run(frames):
        let_go()
        last, known = None, np.zeros(0, np.uint64)
        for frame in frames:
            keep = np.zeros(len(frame), dtype=bool)
            for i, (ta, tb) in enumerate(zip(frame["text_a"], frame["text_b"], strict=True)):
                if last is None or ta != last:
                    last, known = ta, shingles(ta, k)
                keep[i] = jaccard_at_least(known, shingles(tb, k))
            yield pd.DataFrame({"a": frame["a"][keep], "b": frame["b"][keep]})

    return run


def _owners(k: int):
    """Of (id, text): each shingle hash of what the task holds, with the smallest and the largest id that has it."""

    def merged(hashes: list, ids: list) -> pa.RecordBatch:
        h, owner = np.concatenate(hashes), np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in hashes])
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h))[: len(first)] - 1
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(owner[first]), pa.array(owner[last])], names=["h", "lo", "hi"])

    def run(batches):
        let_go()
        hashes, ids, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes.append(shingles(text, k))
                ids.append(i)
                held += len(hashes[-1])
                if held >= HELD:
                    yield merged(hashes, ids)
                    hashes, ids, held = [], [], 0
        if ids:
            yield merged(hashes, ids)

    return run


_BITMAP_DDL = "id long, n long, shared long, " + ", ".join(f"m{i} long" for i in range(BITMAP))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bitmap, as longs, of the places of the hashes."""
    seen = np.zeros(BITMAP * 64, dtype=bool)
    seen[(hashes % _U(BITMAP * 64)).astype(np.int64)] = True
    return np.packbits(seen).view("<i8")


def _bitmaps(k: int):
    """Of (id, text, own), own being hashes that no other document has: the set's size, that of the rest, its bitmap."""

    def run(batches):
        let_go()
        for batch in batches:
            rows = []
            for i, text, own in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "own")), strict=True):
                s = shingles(text, k)
                rest = np.setdiff1d(s, np.array(own or [], dtype=np.int64).view(np.uint64))
                rows.append((i, len(s), len(rest), *bitmap(rest).tolist()))
            if rows:
                names = ["id", "n", "shared", *(f"m{i}" for i in range(BITMAP))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def _may_link(a: str, b: str):
    """False only if the intersection of a's and b's sets is certainly under 4/9 of the sum of their sizes, which is the
    same as a similarity under 0.8."""

    def bound(x: str, y: str):
        missing = sum((F.bit_count(F.col(f"{x}m{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}m{i}")))) for i in range(BITMAP)), F.lit(0))
        return F.col(f"{x}shared") - missing

    return 9 * F.least(bound(a, b), bound(b, a)) >= 4 * (F.col(f"{a}n") + F.col(f"{b}n"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the component's smallest node. Alternating large-star
    and small-star on edge lists; every round is written to the shared folder and only its digest comes to the driver."""

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = both.join(least, "a")
        out = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        last, edges = edges, written(star(star(edges, large=True), large=False), "edges")
        dropped(last)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(texts.mapInArrow(_signatures(k), _SIG_DDL), "signatures")
    # Equal sets: one representative, with pre-aggregation, whatever the number of copies.
    some = sig.where("n_shingles > 0 and doc_id is not null")
    sets = some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = written(some.select("doc_id", "n_shingles", "h1", "h2").join(sets, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "h1", "h2", "rep"), "members")
    reps = written(some.join(sets.withColumnRenamed("rep", "doc_id"), ["n_shingles", "h1", "h2", "doc_id"]).select("doc_id", "keys", "s0", "s1", "s2"), "representatives")
    bands = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    bits_of = reps.select(F.col("doc_id").alias("id"), "s0", "s1", "s2")

    def agree(a: str, b: str):
        return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in (0, 1, 2)), F.lit(0)) <= MAX_BITS

    def side(name: str) -> DataFrame:
        return bits_of.select(F.col("id").alias(name), *[F.col(f"s{i}").alias(f"{name}{i}") for i in (0, 1, 2)])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are alike; texts move only for members of buckets."""
        pairs = written(pairs, "pairs")
        needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        full = written(member_texts.join(needed, "doc_id"), "texts")
        both = pairs.join(full.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(full.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        links = written(both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInPandas(_confirm(k), "a long, b long").distinct(), "links")
        dropped(pairs, full)
        return links

    # 1. Every member of a bucket against the bucket's smallest id, and in larger buckets against the smallest id of
    # a random cell of about CELL members: pairs are as many as members, whatever the buckets' sizes, and in a
    # group of near copies they are enough for nearly all of it to become one component.
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1")
    member_of = written(bands.join(buckets, "key"), "buckets")
    # Texts of members move once, by the same join at every size; what follows draws on these.
    member_texts = written(texts.join(member_of.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id"), "member-texts")
    led = member_of.where("id <> a").select("a", F.col("id").alias("b"))
    cells = member_of.where(F.col("n") > CELL).select("key", "id", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / CELL)).alias("cell"))
    heads = cells.groupBy("key", "cell").agg(F.min("id").alias("a"))
    led = led.unionByName(cells.join(heads, ["key", "cell"]).where("id <> a").select("a", F.col("id").alias("b"))).distinct()
    led = led.join(side("a"), "a").join(side("b"), "b").where(agree("a", "b")).select("a", "b")
    links = confirmed(led)
    roots = components(links)
    # 2. Buckets that still hold several components: their members of different components, by signature.
    rooted = written(member_of.where("n > 2").select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    open_ = written(rooted.join(mixed, "key"), "open")
    held = written(member_texts.select(F.col("doc_id").alias("id"), "text").join(open_.select("id").distinct(), "id"), "texts")
    owners = held.mapInArrow(_owners(k), "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = owners.where("lo = hi").groupBy(F.col("lo").alias("id")).agg(F.collect_list("h").alias("own"))
    maps = written(held.join(own, "id", "left").select("id", "text", "own").mapInArrow(_bitmaps(k), _BITMAP_DDL), "bitmaps")
    # A member whose shingles known to others too are fewer than a link to the bucket's smallest set asks for has none.
    sized = open_.join(maps, "id").join(bits_of, "id")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    few = sized = written(sized.join(least, "key").where("9 * shared >= 4 * (n + least)").drop("least"), "sized")

    def member_side(name: str) -> DataFrame:
        return sized.select("key", F.col("id").alias(name), F.col("root").alias(f"{name}root"), *[F.col(c).alias(f"{name}{c[1:] if c[0] == 's' and c[1:].isdigit() else c}") for c in sized.columns if c not in ("key", "id", "root")])

    # Sizes of linked sets differ by a factor of 1.25 at most, so their classes by one at most.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")
    tiles = sized.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    sized = written(sized.join(tiles, "key").withColumn("size_class", size_class), "tiled")
    x = member_side("a").withColumn("tile", F.pmod(F.xxhash64("a"), F.col("atiles")).cast("int")).withColumnRenamed("asize_class", "size_class").drop("atiles")
    y = member_side("b").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("btiles") - 1))).drop("btiles")
    y = y.withColumn("size_class", F.explode(F.array(*[F.col("bsize_class") + i for i in (-1, 0, 1)]))).drop("bsize_class")
    rest = x.join(y, ["key", "tile", "size_class"]).where((F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot")) & agree("a", "b") & _may_link("a", "b")).select("a", "b").distinct()
    more = confirmed(rest)
    # A doc_id with several texts links their sets.
    same = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id")
    shared = member.join(same, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    if not more.isEmpty() or not shared.isEmpty():
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(stars.unionByName(more).unionByName(shared))
    dropped(reps, member_of, member_texts, links, rooted, open_, held, maps, few, sized, more)
    roots = roots.withColumnRenamed("node", "rep")
    found = member.join(roots, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    rest_ = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest_).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, k: int) -> DataFrame:
    """One document of each group, with all its columns; of rows that share the kept doc_id, the first by text. Rows
    without words are linked with nothing, so all of them stay, whatever their doc_id."""
    out, dup = near_duplicates(docs, k), own_name("dup_id", docs.columns)
    out = written(out.select(F.col("doc_id").alias(dup), F.col("n_shingles").alias(f"{dup}_n"), F.col("kept").alias(f"{dup}_kept")), "kept")
    linked = (F.col("doc_id") == F.col(dup)) & F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    left = docs.join(out.where(f"not {dup}_kept").select(dup).distinct(), linked, "left_anti")
    repeated = out.where(f"{dup}_kept and {dup}_n > 0 and {dup} is not null").groupBy(dup).agg(F.count("*").alias("n")).where("n > 1").select(dup)
    if repeated.isEmpty():
        return left
    again = left.join(repeated, linked, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("row")).select("row.*")
    return left.join(repeated, linked, "left_anti").unionByName(again)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS n_both FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS doc_id, MIN(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(root, d.doc_id) AS component_id, COALESCE(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN root USING (doc_id)
"""
