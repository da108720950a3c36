"""Repeated passages: bytes covered by a string of LENGTH bytes that also starts elsewhere, found by suffix sorting.

Anchors thin out the suffixes: of the hashed GRAM-byte windows of every LENGTH bytes the least ones are anchors, so equal
strings hold equal anchors at equal places. Anchors seen once in the corpus cannot be in a repeat. Around each other
anchor the context is cut that strings of LENGTH bytes around it can touch; equal contexts (by 128-bit digests) are
folded and counted. The contexts of an anchor are then put in suffix order by deep-shallow sorting, forward from the
anchor and backward from it: multikey quicksort, eight bytes a key, to SHALLOW bytes, then blind tries for the groups
that still agree. With the common prefixes of neighbours in both orders, two contexts share the string that starts d
bytes before the anchor if and only if they are in one run of at least d bytes backward and LENGTH - d forward.

All these strings hold the anchor's bytes, so those of one context cover a single span.

A group of over MAX_GROUP contexts is parted by further bytes before it is sorted: its places d are halved, and for each
half the contexts that agree in all bytes that every string of that half covers form a group. In each half contexts are
cut to the bytes that its strings touch, and those equal there are folded: they share all their strings, so their spans
are known, and one of them stays as the others' partner. Groups that hold a single context or only known ones are done.
Parting goes on while groups are too large; at a single d equal contexts are equal strings, and folding ends it. So no
task holds an unbounded group, a part only ever loses contexts that cannot match the others there, and a context whose
strings repeat up to some place goes through a few parts a level and not through one for every d.

Inside a long run of a short period (padding, rules of one sign) every string repeats within the run, so the run is
removed as it is, and only the anchors near its ends stand for it elsewhere.

Cases: null text is empty; texts under LENGTH bytes keep all; matches never cross documents but may overlap in one;
repeated rows repeat each other's text and lose it; null and repeated doc_ids are rows like others; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, small_batches, table, written

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
SHALLOW = 64
#: Contexts of a group that is sorted as a whole; larger ones are parted.
MAX_GROUP = 32_768
#: Contexts sorted together in a task, and bytes of contexts that a task folds before it hands them on.
CHUNK, HELD_BYTES = 20_000, 32 << 20
#: Bytes of a text searched for anchors at a time; results do not depend on it.
PIECE = 4 << 20
#: Runs of at least LONG_RUN bytes with a period of at most PERIODS are taken as a whole; anchors KEEP from their ends stay.
LONG_RUN, PERIODS = 2048, 16
KEEP = 2 * LENGTH + PERIODS
_U = np.uint64


def _slide(v: np.ndarray, w: int, pick) -> np.ndarray:
    span = 1
    n = len(v) - w + 1
    while span * 2 <= w:
        v = pick(v[:-span], v[span:])
        span *= 2
    return pick(v[:n], v[w - span : w - span + n]) if span < w else v


def periodic_runs(raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs (a, b) of at least LONG_RUN bytes that repeat with a period of at most PERIODS."""
    if len(raw) < LONG_RUN:
        return []
    data, step = np.frombuffer(raw, np.uint8), LONG_RUN // 4
    heads = data[: len(data) // step * step].reshape(-1, step)[:, : 4 * PERIODS]  # every long run holds several heads
    todo = np.ones(len(heads), dtype=bool)
    found = set()
    for q in range(1, PERIODS + 1):
        at = np.flatnonzero((heads[:, q:] == heads[:, :-q]).all(axis=1) & todo)
        if len(at):
            todo[at] = False
            parts = np.concatenate([[-1], np.flatnonzero(data[q:] != data[:-q]), [len(data) - q]])
            i = np.searchsorted(parts, at * step)
            found |= {(a, b) for a, b in zip((parts[i - 1] + 1).tolist(), (parts[i] + q).tolist(), strict=True) if b - a >= LONG_RUN}
    return sorted(found)


def _least_grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    for span, c in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h = h[:-span] * _U(c) + h[span:]
        h ^= h >> _U(29)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    least = _slide(h, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    reach = _slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
    places = np.flatnonzero(reach == h)
    return places, h[places].view(np.int64)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least in some LENGTH bytes of the text, without those inside long runs."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) <= PIECE + LENGTH:
        places, hashes = _least_grams(raw)
    else:  # a string of LENGTH bytes starts in one piece
        starts = range(0, len(raw) - LENGTH + 1, PIECE)
        got = [_least_grams(raw[a : a + PIECE + LENGTH - 1]) for a in starts]
        places, first = np.unique(np.concatenate([p + a for a, (p, _) in zip(starts, got, strict=True)]), return_index=True)
        hashes = np.concatenate([h for _, h in got])[first]
    for a, b in periodic_runs(raw):
        stay = (places < a + KEEP) | (places >= b - KEEP)
        places, hashes = places[stay], hashes[stay]
    return places, hashes


def _emit_anchors(batches):
    schema = pa.schema([("dk", pa.int64()), ("tk", pa.int64()), ("h", pa.int64()), ("pos", pa.int32())])
    for batch in batches:
        dk, tk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "tk"))
        found = [anchors((t or "").encode()) for t in batch.column("text").to_pylist()]
        if not found:
            continue
        n = [len(p) for p, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(dk, n)), pa.array(np.repeat(tk, n)), pa.array(np.concatenate([h for _, h in found])), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))], schema=schema)


def _pack(batches):
    """Texts compressed for a shuffle."""
    import zstandard

    codec = zstandard.ZstdCompressor(level=1)
    schema = pa.schema([("doc_id", pa.int64()), ("dk", pa.int64()), ("tk", pa.int64()), ("packed", pa.binary())])
    for batch in batches:
        packed = pa.array([codec.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "dk", "tk")), packed], schema=schema)


def packed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "dk", "tk", "text").mapInArrow(_pack, "doc_id long, dk long, tk long, packed binary")


_PLACES = pa.schema([("dk", pa.int64()), ("tk", pa.int64()), ("pos", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("nleft", pa.int32()), ("context", pa.binary())])
_PLACES_DDL = "dk long, tk long, pos int, c1 long, c2 long, k long, n long, nleft int, context binary"


def _emit_contexts(batches):
    """Rows of two kinds: each repeated anchor's place with its context's digest, and (pos null) each context that the
    task has seen, with its anchor's hash and how often it was seen."""
    import zstandard

    codec = zstandard.ZstdDecompressor()
    held: dict[bytes, list] = {}
    size = 0

    def contexts() -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(held), dtype="<i8").reshape(-1, 2)
        n, nleft, k, context = zip(*held.values(), strict=True)
        columns = {"c1": digests[:, 0], "c2": digests[:, 1], "k": k, "n": n, "nleft": nleft, "context": context}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(n), f.type) for f in _PLACES], schema=_PLACES)

    for batch in batches:
        rows: list[tuple] = []
        digests: list[bytes] = []
        for dk, tk, packed_, marks in zip(*(batch.column(c).to_pylist() for c in ("dk", "tk", "packed", "marks")), strict=True):
            raw = codec.decompress(packed_)
            for m in marks:
                at = m["pos"]
                context, nleft = raw[max(0, at - LEFT) : at + LENGTH], min(at, LEFT)
                digest = hashlib.blake2b(context, digest_size=16, salt=nleft.to_bytes(2, "little")).digest()
                digests.append(digest)
                rows.append((dk, tk, at))
                if (seen := held.get(digest)) is not None:
                    seen[0] += 1
                else:
                    held[digest] = [1, nleft, m["h"], context]
                    size += len(context)
        if rows:
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLACES.types, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.nulls(len(rows), t) for t in _PLACES.types[5:])], schema=_PLACES)
        if size > HELD_BYTES:
            yield contexts()
            held, size = {}, 0
    if held:
        yield contexts()


class BlindTrie:
    """Patricia trie of distinct equal-ended strings: inner nodes keep only the place and byte where paths part."""

    def __init__(self, first: int, strings: list[bytes]):
        self.strings, self.root = strings, first

    @staticmethod
    def parted(a: bytes, b: bytes) -> int:
        """Length of the common prefix of different strings, of which neither begins with the other."""
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (differ.bit_length() + 7) // 8

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):  # blind: only the branching bytes are looked at
            byte, children = s[node[0]], node[1]
            node = children[byte] if byte in children else next(iter(children.values()))
        depth = self.parted(s, self.strings[node])
        up, byte, node = None, 0, self.root
        while not isinstance(node, int) and node[0] < depth:
            up, byte, node = node, s[node[0]], node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = i
            return
        other = node
        while not isinstance(other, int):
            other = next(iter(other[1].values()))
        branch = (depth, {self.strings[other][depth]: node, s[depth]: i})
        if up is None:
            self.root = branch
        else:
            up[1][byte] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the strings by group, then bytes; with it the common prefix with the string before (-1 at a group's
    first), both along the order. Equal strings keep their places."""
    n = len(strings)
    width = max(8, -(-max(map(len, strings), default=1) // 8) * 8)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    table_ = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), dtype=np.uint8).reshape(n, width)
    words = table_.view(">u8")
    order = np.argsort(group, kind="stable")
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    klass = np.cumsum(first) - 1
    # Shallow: multikey quicksort, all open classes at once, a key of eight bytes a step.
    for k in range(min(SHALLOW, width) // 8):
        sizes = np.bincount(klass)
        open_ = np.flatnonzero(sizes[klass] > 1)
        if not len(open_):
            break
        keys = words[order[open_], k]
        by = np.lexsort((keys, klass[open_]))
        order[open_], keys = order[open_][by], keys[by]
        new = np.zeros(n, dtype=bool)
        new[1:] = klass[1:] != klass[:-1]
        same = np.zeros(len(open_), dtype=bool)
        same[1:] = (keys[1:] != keys[:-1]) & (klass[open_][1:] == klass[open_][:-1])
        new[open_[same]] = True
        klass = np.cumsum(new)
    # Deep: a blind trie for each class that is still open.
    edges = np.flatnonzero(np.concatenate([[True], klass[1:] != klass[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            members: dict[tuple[bytes, int], list[int]] = {}
            for i in order[a:b].tolist():
                members.setdefault((strings[i].ljust(width, b"\0") + len(strings[i]).to_bytes(4, "big")), []).append(i)
            distinct = list(members)
            trie = BlindTrie(0, distinct)
            for i in range(1, len(distinct)):
                trie.insert(i)
            order[a:b] = [i for d in trie.order() for i in members[distinct[d]]]
    x, y = table_[order[1:]], table_[order[:-1]]
    differ = x != y
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    prefix = np.concatenate([[-1], np.where(group[order[1:]] == group[order[:-1]], common, -1)])[:n]
    return order, prefix, lengths


def repeated_starts(group: np.ndarray, lefts: list[bytes], rights: list[bytes], many: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """For each context (row) and each d (column) from its d0 to its d1, whether the string that starts d bytes before
    the anchor occurs in another context of the group too, or the context itself does (many)."""
    n = len(group)
    by_right, right_prefix, right_length = deep_shallow(group, rights)
    by_left, left_prefix, left_length = deep_shallow(group, [s[::-1] for s in lefts])
    out = np.zeros((n, LEFT + 1), dtype=bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(LEFT + 1):
        fits = (d0 <= d) & (d <= d1) & (left_length >= d) & (right_length >= LENGTH - d)
        if not fits.any():
            continue
        right_class[by_right] = np.cumsum(right_prefix < LENGTH - d)
        left_class[by_left] = np.cumsum(left_prefix < d)
        rows = np.flatnonzero(fits)
        key = right_class[rows] * (n + 1) + left_class[rows]
        o = np.argsort(key, kind="stable")
        s = key[o]
        twin = np.zeros(len(s), dtype=bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:].copy()
        out[rows[o], d] = twin
        out[rows, d] |= many[rows]
    return out


_FOUND = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
_FOUND_DDL = "c1 long, c2 long, a int, b int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    """Covered bytes, from the anchor on, of complete groups of (k, d0, d1, c1, c2, n, nleft, context): strings that
    start d0 to d1 bytes before it. A context may come several times, with its counts; those without c1 are partners."""
    distinct: dict[tuple, list] = {}
    for k, d0, d1, c1, c2, n, nleft, context in rows:
        if (seen := distinct.get((k, d0, nleft, context))) is not None:
            seen[0] += n
        else:
            distinct[k, d0, nleft, context] = [n, d1, c1, c2]
    low, high = np.array([x[1] for x in distinct]), np.array([x[1] for x in distinct.values()])
    group = np.unique(np.array([x[:2] for x in distinct], dtype=np.int64), axis=0, return_inverse=True)[1].ravel()
    hit = repeated_starts(group, [context[:nleft] for _, _, nleft, context in distinct], [context[nleft:] for _, _, nleft, context in distinct], np.array([x[0] > 1 for x in distinct.values()]), low, high)
    first, last = hit.argmax(axis=1), LEFT - hit[:, ::-1].argmax(axis=1)
    at = np.flatnonzero(hit.any(axis=1) & np.array([x[2] is not None for x in distinct.values()]))
    own = list(distinct.values())
    columns = [own[i][2] for i in at.tolist()], [own[i][3] for i in at.tolist()], -last[at], LENGTH - first[at]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)


_GROUPED = ("k", "d0", "d1", "c1", "c2", "n", "nleft", "context")


def _sort_groups(batches):
    """Rows sorted by k: whole groups, CHUNK contexts or more at a time."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in _GROUPED), strict=True)
        if len(held) >= CHUNK and held[0][0] != held[-1][0]:
            at = len(held) - 1
            while held[at - 1][0] == held[-1][0]:
                at -= 1
            done, held = held[:at], held[at:]
            yield _spans(done)
    if held:
        yield _spans(held)


#: What a context is in its group, by its bytes.
_BYTES = ("k", "d0", "d1", "nleft", "context")


def _halves(nodes: DataFrame) -> DataFrame:
    """The groups' contexts in groups of the lower and the upper half of d0 to d1, by all bytes that a half's strings
    share, cut to the bytes that they touch; contexts too short for a half are not in it."""
    middle = F.floor((F.col("d0") + F.col("d1")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("d0").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("d1").alias("b"))))
    rows = nodes.select("c1", "c2", "n", "nleft", "context", half.alias("half")).select("c1", "c2", "n", "nleft", "context", F.col("half.a").alias("d0"), F.col("half.b").alias("d1"))
    rows = rows.where(f"d0 <= d1 and d0 <= nleft and length(context) - nleft >= {LENGTH} - d1")
    shared = F.expr(f"substring(context, nleft - d0 + 1, d0 + {LENGTH} - d1)")
    touched = F.expr(f"substring(context, nleft - least(nleft, d1) + 1, least(nleft, d1) + {LENGTH} - d0)")
    known = [F.expr(f"if(n > 1, null, {c})").alias(c) for c in ("c1", "c2")]
    return rows.select(F.xxhash64("d0", shared).alias("k"), "d0", "d1", *known, "n", F.least("nleft", "d1").alias("nleft"), touched.alias("context"))


def _folded(rows: DataFrame) -> DataFrame:
    """Contexts equal in their group as one row: n over 1, and c1 null if it stands for several or known ones."""
    one = rows.groupBy(*_BYTES).agg(F.sum("n").alias("n"), F.min("c1").alias("c1"), F.min("c2").alias("c2"))
    return one.select("k", "d0", "d1", *(F.expr(f"if(n > 1, null, {c})").alias(c) for c in ("c1", "c2")), "n", "nleft", "context")


def _whole_spans(rows: DataFrame) -> DataFrame:
    """Spans of contexts whose strings all repeat: all their bytes."""
    return rows.select("c1", "c2", (-F.col("nleft")).alias("a"), (F.length("context") - F.col("nleft")).alias("b"))


def _undecided(groups: DataFrame) -> DataFrame:
    """Groups with several contexts of which some are not known, each in one task and sorted by k."""
    of_group = Window.partitionBy("k")
    rows = groups.repartition("k").withColumns({"m": F.count("*").over(of_group), "open": F.count("c1").over(of_group)})
    return rows.where("m > 1 and open > 0").sortWithinPartitions("k").select(*_GROUPED)


def _large(groups: DataFrame, max_group: int) -> DataFrame:
    """Large groups, and whether they have contexts that are not known."""
    sizes = groups.groupBy("k").agg(F.count("*").alias("m"), (F.count("c1") > 0).alias("open"))
    return written(sizes.where(F.col("m") > max_group).select("k", "open"), "large")


def _parted(groups: DataFrame, max_group: int) -> list[DataFrame]:
    """Spans of the contexts of large groups, in tables; a context may be in several."""
    whole = groups.groupBy("c1", "c2", *_BYTES).agg(F.sum("n").alias("n"))
    nodes = written(whole, "nodes")
    parts = [written(_whole_spans(nodes.where("n > 1")), "found")]
    while True:
        halves = written(_halves(nodes), "halves")
        folded = written(_folded(halves), "folded")
        several = folded.where("n > 1").select("k", "d0", "nleft", "context")
        parts.append(written(_whole_spans(halves.where("c1 is not null").join(several, ["k", "d0", "nleft", "context"], "left_semi")), "found"))
        large = _large(folded, max_group)
        some = not large.where("open").isEmpty()
        usual = folded.join(large, "k", "left_anti")
        parts.append(written(_undecided(usual).mapInArrow(_sort_groups, _FOUND_DDL), "found"))
        dropped(nodes, halves)
        if some:
            nodes = written(folded.join(large.where("open"), "k", "left_semi").where("d0 < d1"), "nodes")
        dropped(folded, large)
        if not some:
            return parts


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    import zstandard

    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc_id, packed_, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "spans")), strict=True):
            raw = codec.decompress(packed_)
            kept, runs = kept_bytes(raw, [*((s["a"], s["b"]) for s in spans or ()), *periodic_runs(raw)])
            rows.append((doc_id, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    parts, end, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > end or not runs:
            parts.append(raw[end:a])
            runs += 1
        end = max(end, b)
    return b"".join([*parts, raw[end:]]), runs


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(dk, tk, spans): per document, by keyed(), the byte spans that repeated strings cover around each anchor. Every
    table is deleted once the next one is there."""
    small_batches(docs.sparkSession)
    every = written(docs.mapInArrow(_emit_anchors, "dk long, tk long, h long, pos int"), "anchors")
    seen = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    marks = written(every.join(seen, "h", "left_semi").groupBy("dk", "tk").agg(F.collect_set(F.struct("pos", "h")).alias("marks")), "marks")
    dropped(every)
    places = written(packed(docs).join(marks, ["dk", "tk"]).mapInArrow(_emit_contexts, _PLACES_DDL), "contexts")
    dropped(marks)
    groups = places.where("pos is null").select("k", F.lit(0).alias("d0"), F.lit(LEFT).alias("d1"), *_GROUPED[3:])
    large = _large(groups, max_group)
    some = not large.isEmpty()
    usual = groups.join(large, "k", "left_anti") if some else groups
    parts = [written(usual.repartition("k").sortWithinPartitions("k").select(*_GROUPED).mapInArrow(_sort_groups, _FOUND_DDL), "found")]
    found = parts[0]
    if some:
        parts += _parted(groups.join(large, "k", "left_semi"), max_group)
        found = found.unionByName(reduce(DataFrame.unionByName, parts[1:]).groupBy("c1", "c2").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    dropped(large)
    hits = places.where("pos is not null").select("dk", "tk", "pos", "c1", "c2").join(found, ["c1", "c2"])
    one = hits.select("dk", "tk", F.struct((F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b")).alias("s"))
    spans = written(one.groupBy("dk", "tk").agg(F.collect_set("s").alias("spans")), "spans")
    dropped(places, *parts)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, dk, tk): keys that tell rows of one doc_id apart by their texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("dk"), F.xxhash64(F.lit(8), "text").alias("tk"))


def drop_repeats(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    rows = keyed(docs)
    cut = packed(rows).join(repeated_spans(rows, max_group), ["dk", "tk"], "left").select("doc_id", "packed", "spans")
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))
