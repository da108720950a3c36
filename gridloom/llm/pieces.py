"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for every piece that matches at a place; a path's score is the sum of its pieces'
scores. A forward Viterbi pass gives the best score to reach each place, and these are exact heuristics for an A-star
search backward from the end, which so finds the N best paths in order. No piece but runs of the space mark has that
mark after its first character, so the lattice falls apart at words. The forward pass keeps two scores a place, so each
word's best path and what its second best loses are known; among a text's N best paths only the N - 1 words that lose
least can change, so the A-star search runs on those, and the text's N best are merged from their lists. The output has
the best path's ids and what each other path changes in them; path_ids() puts a path together.

Piece scores are the model file's, or with scores="zipf" the logarithm of 1 / (rank + 1): a BPE file holds merge ranks
rather than log probabilities. Uncovered characters become byte pieces at a penalty, as the library does it.
Of equal scores the best path is the one with fewer pieces, then smaller ids; the others come in a fixed order.

Cases: null text is empty: no pieces, one path of score 0; spaces are kept as they are, with a mark before the first;
texts of any length are encoded whole; repeated rows are encoded each; an empty table gives an empty result. Added
columns replace input columns of the same names.
"""

from __future__ import annotations

import heapq
import re
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdLists, kept, small_batches, split_words, sums, table

N_BEST = 4
MARK = "▁"
#: What an uncovered character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words, and ids of words, of a Python worker's table, which then starts anew; words beyond LONG_WORD go another way.
CACHE_WORDS, CACHE_IDS, LONG_WORD = 800_000, 1 << 24, 64
#: Bytes of texts encoded together, and the least words of a length worth a joint pass; results depend on neither.
GROUP_BYTES, GROUP_WORDS = 8 << 20, 8
#: Ids that are decoded together; results do not depend on it.
DECODE_IDS = 1 << 22
INF, EPS = float("inf"), 1e-9
WORDS = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")


class Pieces:
    def __init__(self, path: str, scores: str = "model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = []
        self.bytes: list[int | None] = []
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append("" if sp.is_control(i) or sp.is_unknown(i) else piece)
            value = int(piece[3:5], 16) if sp.is_byte(i) else None
            self.bytes.append(value)
            if value is not None:
                self.byte_ids[value] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[piece] = (i, sp.get_score(i))
        if scores == "zipf":
            order = sorted(self.ids, key=lambda p: (-self.ids[p][1], self.ids[p][0]))
            self.ids = {p: (self.ids[p][0], -float(np.log(r + 1.0))) for r, p in enumerate(order, 1)}
        self.unknown = min(s for _, s in self.ids.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.prefixes: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.ids
        self._build_trie()
        self.spaced = pa.array([x.replace(MARK, " ") for x in self.text])
        self.is_byte = np.array([b is not None for b in self.bytes])
        self.start_anew()

    def start_anew(self) -> None:
        """An empty table of words: their ids, best scores, losses of the second best, and some words' n best."""
        self.table, self.names = IdLists(), []
        self.scores = self.losses = np.empty(1 << 12)
        self.lists: dict[int, list[tuple[float, tuple[int, ...]]]] = {}

    def _build_trie(self) -> None:
        """The prefixes as a trie in arrays: node 0 is empty, a step from a node by a character's class is a search in
        sorted keys."""
        alphabet = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self.alone = np.zeros(len(alphabet) + 1, dtype=bool)  # the character is itself a piece
        for k, c in enumerate(alphabet, 1):
            self.classes[ord(c)], self.alone[k] = k, c in self.ids
        self.width = len(alphabet) + 1
        nodes = {p: i for i, p in enumerate(["", *self.prefixes])}
        keys = np.array([nodes[p[:-1]] * self.width + int(self.classes[ord(p[-1])]) for p in self.prefixes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = np.append(keys[order], np.iinfo(np.int64).max), (order + 1).astype(np.int64)
        self.node_id, self.node_score = np.full(len(nodes), -1, dtype=np.int32), np.zeros(len(nodes))
        for p, (i, score) in self.ids.items():
            self.node_id[nodes[p]], self.node_score[nodes[p]] = i, score

    def edges(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the (start, score, ids) of pieces that end there; an uncovered character is its bytes."""
        n, out, ids = len(s), [[] for _ in range(len(s) + 1)], self.ids
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                if found := ids.get(s[a:b]):
                    out[b].append((a, found[1], (found[0],)))
            if s[a] not in ids:
                out[a + 1].append((a, self.unknown, tuple(self.byte_ids[x] for x in s[a].encode("utf-8", "surrogatepass"))))
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of the lattice of s, best first: (score, ids)."""
        edges = self.edges(s)
        reach = [0.0] + [-INF] * len(s)
        for b in range(1, len(s) + 1):
            reach[b] = max((reach[a] + w for a, w, _ in edges[b]), default=-INF)
        out, order = [], count()
        heap = [(-round(reach[-1], 9), len(s), next(order), 0.0, None)]
        while heap and len(out) < n:
            _, at, _, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for a, w, ids in edges[at]:
                if reach[a] > -INF:  # of equal scores the path that is nearest to the start goes on: ties don't pile up
                    heapq.heappush(heap, (-round(reach[a] + w + done, 9), a, next(order), done + w, (ids, path)))
        return out

    def viterbi(self, s: str) -> tuple[float, float, bytes]:
        """Best score, what the second best path loses (infinite without one), and the best path's ids."""
        n, get = len(s), self.prefixes.get
        first, second = [0.0] + [-INF] * n, [-INF] * (n + 1)
        back: list[tuple] = [(0, ())] * (n + 1)

        def path(at: int, ids: tuple = ()) -> tuple:
            while at:
                at, own = back[at]
                ids = own + ids
            return len(ids), ids

        def offer(a: int, b: int, w: float, least: float, ids: tuple) -> None:
            """A path to b over a: w is its score, least that of a's second best with the same edge."""
            best = first[b]
            if w > best + EPS or w > best - EPS and path(a, ids) < path(b):
                first[b], back[b] = w, (a, ids)
                second[b] = best if best > least else least
            elif w > second[b]:
                second[b] = w

        for a in range(n):
            f, g, known = first[a], second[a], False
            for b in range(a + 1, n + 1):
                found = get(s[a:b], 0)
                if not found:
                    if found is None:
                        continue
                    break
                i, score = found
                if b == a + 1:
                    known = True
                w = f + score
                if first[b] == -INF:  # the first path to come here
                    first[b], second[b], back[b] = w, g + score, (a, (i,))
                    continue
                if w < second[b]:
                    continue
                offer(a, b, w, g + score, (i,))
            if not known:
                offer(a, a + 1, f + self.unknown, g + self.unknown, tuple(self.byte_ids[x] for x in s[a].encode("utf-8", "surrogatepass")))
        return first[n], first[n] - second[n], np.array(path(n)[1], dtype="<i4").tobytes()

    def viterbi_many(self, words: list[str]) -> list[tuple[float, float, bytes]]:
        """viterbi of words of one length, position by position for all of them at once."""
        n, m = len(words[0]), len(words)
        chars = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(m, n).T
        cls = self.classes[chars]
        known = self.alone[cls]
        first, second = np.full((n + 1, m), -INF), np.full((n + 1, m), -INF)
        back, ids = np.zeros((n + 1, m), dtype=np.int32), np.zeros((n + 1, m), dtype=np.int32)
        first[0] = 0.0

        def own_ids(i: int) -> tuple:
            return (i,) if i >= 0 else tuple(self.byte_ids[x] for x in chr(-1 - i).encode("utf-8", "surrogatepass"))

        def path(at: int, word: int, out: tuple = ()) -> tuple:
            while at:
                at, out = int(back[at, word]), own_ids(int(ids[at, word])) + out
            return len(out), out

        def offer(a: int, b: int, to: np.ndarray, score: np.ndarray | float, own: np.ndarray) -> None:
            """Paths to b over a for the words `to`; own: the piece, or -1 less the code point of an uncovered one."""
            w, least, best, under = first[a, to] + score, second[a, to] + score, first[b, to], second[b, to]
            better = w > best + EPS
            for t in np.flatnonzero(~better & (w > best - EPS) & (w >= under)).tolist():
                better[t] = path(a, to[t], own_ids(int(own[t]))) < path(b, to[t])
            second[b, to] = np.where(better, np.maximum(best, least), np.maximum(under, w))
            win = to[better]
            first[b, win], back[b, win], ids[b, win] = w[better], a, own[better]

        for a in range(n):
            at, node = np.arange(m), np.zeros(m, dtype=np.int64)
            for b in range(a + 1, n + 1):
                key = node * self.width + cls[b - 1, at]
                place = np.searchsorted(self.keys, key)
                found = self.keys[place] == key
                at, node = at[found], self.targets[place[found]]
                if not len(at):
                    break
                own = self.node_id[node]
                ends = own >= 0
                offer(a, b, at[ends], self.node_score[node[ends]], own[ends])
            alien = np.flatnonzero(~known[a])
            if len(alien):
                offer(a, a + 1, alien, self.unknown, -1 - chars[a, alien].astype(np.int32))
        at, columns, steps, on = np.full(m, n, dtype=np.int64), np.arange(m), [], []
        while at.any():
            steps.append(ids[at, columns])
            on.append(at > 0)
            at = back[at, columns].astype(np.int64)
        flat = np.stack(steps[::-1]).T[np.stack(on[::-1]).T]  # word by word, in the order of the text
        data, stops = flat.astype("<i4").tobytes(), (4 * np.sum(on, axis=0).cumsum()).tolist()
        out = [(f, lost, data[x:y]) for f, lost, x, y in zip(first[n].tolist(), (first[n] - second[n]).tolist(), [0, *stops[:-1]], stops, strict=True)]
        for k in np.flatnonzero(~known.all(axis=0)).tolist():
            out[k] = (*out[k][:2], np.array(path(n, k)[1], dtype="<i4").tobytes())
        return out

    def learn(self, words: set[str]) -> None:
        """Put new words in the table; those of equal length are found together."""
        by_length: dict[int, list[str]] = {}
        for w in sorted(words):
            by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            if n > LONG_WORD:
                got = list(map(self.long_word, own))
            else:
                got = self.viterbi_many(own) if len(own) >= GROUP_WORDS else list(map(self.viterbi, own))
            score, loss, ids = zip(*got, strict=True)
            at = len(self.names)
            self.names += own
            self.table.add(own, np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), dtype="<i4"))
            while len(self.names) > len(self.scores):
                self.scores, self.losses = (np.concatenate([x, np.empty_like(x)]) for x in (self.scores, self.losses))
            if self.losses is self.scores:
                self.losses = self.scores.copy()
            self.scores[at : len(self.names)], self.losses[at : len(self.names)] = score, loss

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers in the table; new ones are learned."""
        get = self.table.index.get
        got = list(map(get, words))
        if None in got:
            self.learn({w for w, g in zip(words, got, strict=True) if g is None})
            got = list(map(get, words))
        return np.array(got, dtype=np.int64)

    def long_word(self, w: str) -> tuple[float, float, bytes]:
        """As viterbi, by the search: paths of long words are too long to carry along."""
        paths = self.n_best(w, 2)
        return paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else INF, np.asarray(paths[0][1], dtype="<i4").tobytes()

    def words(self, text: str) -> list[str]:
        return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def in_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, numbers) of the words of each text."""
        odd = pc.equal(pc.binary_length(texts), 0)
        for found in (pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " ")):
            odd = pc.or_(odd, found)
        odd = odd.to_numpy(zero_copy_only=False)
        offsets, codes, words = split_words(texts.filter(pa.array(~odd)) if odd.any() else texts)
        numbers = self.numbers([MARK + w for w in words.to_pylist()])[codes] if len(codes) else np.zeros(0, np.int64)
        if not odd.any():
            return offsets.astype(np.int64), numbers
        parts = [numbers[:0]] * len(texts)
        for i, a, b in zip(np.flatnonzero(~odd).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts[i] = numbers[a:b]
        for i in np.flatnonzero(odd).tolist():
            parts[i] = self.numbers(self.words(texts[i].as_py()))
        return np.cumsum([0, *map(len, parts)]), np.concatenate(parts)

    def encode_all(self, texts: pa.Array, n: int = N_BEST) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[tuple]]]]:
        """(number of ids of each text's best path, all ids, its n best scores, each path's changes); null is empty.
        Changes are (first id in the best path, ids there, own ids), in rising order."""
        if len(self.names) > CACHE_WORDS or self.table.used > CACHE_IDS:
            self.start_anew()
        offsets, numbers = self.in_words(pc.fill_null(texts, ""))
        lengths, ids = self.table.gather(numbers)
        firsts = np.cumsum(lengths) - lengths
        score, loss = self.scores[numbers], self.losses[numbers]
        totals, full = np.zeros(len(texts)), offsets[1:] > offsets[:-1]
        if full.any():
            totals[full] = np.add.reduceat(score, offsets[:-1][full])
        best, changed = [], []
        for a, b, total in zip(offsets[:-1].tolist(), offsets[1:].tolist(), totals.tolist(), strict=True):
            few = np.arange(a, b)
            if b - a >= n:  # the words that lose least; of equal losses the first words
                own = loss[a:b]
                few = a + np.flatnonzero(own <= np.partition(own, n - 2)[n - 2]) if n > 1 else few[:0]
            few = few[np.argsort(loss[few], kind="stable")][: n - 1]
            paths: list[tuple[float, dict]] = [(0.0, {})]
            for i, k in zip(few.tolist(), numbers[few].tolist(), strict=True):
                options = self.lists.get(k)
                if options is None:
                    options = self.lists[k] = self.n_best(self.names[k], n)
                paths = sorted(((s + options[0][0] - p, c | {i: x} if j else c) for s, c in paths for j, (p, x) in enumerate(options)), key=lambda x: x[0])[:n]
            best.append([total - s for s, _ in paths])
            spans = {i: (int(firsts[i] - firsts[a]), int(lengths[i])) for i in {i for _, c in paths for i in c}}
            changed.append([[(*spans[i], c[i]) for i in sorted(c)] for _, c in paths])
        return sums(lengths, offsets), ids, best, changed

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[np.ndarray, list[float], list[list[tuple]], bool]:
        """Ids of the best path, the n best scores, each path's changes, and whether the ids decode to the text."""
        _, ids, best, changed = self.encode_all(pa.array([text], pa.string()), n)
        return ids, best[0], changed[0], self.decode(ids.tolist()) == (text or "").replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of a path: byte pieces as UTF-8, marks as spaces, without the first."""
        parts, pending = [], bytearray()
        for i in ids:
            if (b := self.bytes[i]) is not None:
                pending.append(b)
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending.clear()
            parts.append(self.text[i])
        parts.append(pending.decode("utf-8", "replace"))
        out = "".join(parts).replace(MARK, " ")
        return out[1:] if out.startswith(" ") else out

    def decode_all(self, offsets: np.ndarray, values: np.ndarray) -> pa.ChunkedArray:
        """decode of each of many paths: path i is values[offsets[i]:offsets[i + 1]]. Paths without byte pieces are
        joined together, the others decoded one by one."""
        chunks, at, n = [], 0, len(offsets) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODE_IDS, "right")) - 1)
            own, cuts = values[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), self.spaced.take(pa.array(own))), "")
            joined = pc.if_else(pc.starts_with(joined, " "), pc.binary_replace_slice(joined.cast(pa.binary()), 0, 1, b"").cast(pa.string()), joined)
            n_bytes = np.concatenate([[0], np.cumsum(self.is_byte[own])])[cuts]
            odd = np.flatnonzero(np.diff(n_bytes))
            if len(odd):
                mask = np.zeros(end - at, dtype=bool)
                mask[odd] = True
                joined = pc.replace_with_mask(joined, pa.array(mask), pa.array([self.decode(own[cuts[i] : cuts[i + 1]].tolist()) for i in odd.tolist()], pa.string()))
            chunks.append(joined)
            at = end
        return pa.chunked_array(chunks, pa.string())


_CHANGE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ADDED = [("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("nbest_scores", pa.list_(pa.float64())), ("nbest_changes", pa.list_(pa.list_(_CHANGE))), ("round_trip", pa.bool_())]
_ADDED_DDL = "ids array<int>, n_pieces long, nbest_scores array<double>, nbest_changes array<array<struct<at:int,n:int,ids:array<int>>>>, round_trip boolean"


def path_ids(ids, changes) -> list[int]:
    """Ids of one of the N best paths, from those of the best and the path's (at, n, ids) of nbest_changes."""
    out, done = [], 0
    for at, n, own in changes:
        out += [*ids[done:at], *own]
        done = at + n
    return [*out, *ids[done:]]


def _lists(counts, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)), values)


def _changes(paths: list[list[list[tuple[int, int, tuple[int, ...]]]]]) -> pa.ListArray:
    """A column of each row's paths' changes."""
    rows = [c for row in paths for c in row]
    flat = [x for c in rows for x in c]
    ids = _lists([len(x[2]) for x in flat], pa.array([i for x in flat for i in x[2]], pa.int32()))
    structs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), ids], fields=list(_CHANGE))
    return _lists([len(row) for row in paths], _lists([len(c) for c in rows], structs))


def _pieces(path: str, scores: str) -> Pieces:
    """A Python worker's pieces, with their cache, which its next tasks use again."""
    return kept(Pieces, path, scores)


def _encode(path: str, n: int, scores: str, keep: list[str]):
    def run(batches):
        pieces = _pieces(path, scores)

        def packed(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            text = rows.column("text").cast(pa.string())
            counts, values, lists, changed = pieces.encode_all(text, n)
            offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            wanted = pc.replace_substring(pc.fill_null(text, ""), MARK, " ")
            same = pc.equal(pieces.decode_all(offsets, values), pa.chunked_array([wanted])).combine_chunks()
            best = _lists([len(x) for x in lists], pa.array([s for x in lists for s in x], pa.float64()))
            added = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)), pa.array(counts, pa.int64()), best, _changes(changed), same]
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *added], names=[*keep, *(a for a, _ in _ADDED)])

        held, size = [], 0
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


def encoded(docs: DataFrame, model: str, n: int = N_BEST, scores: str = "model") -> DataFrame:
    """All columns but text, and ids of the best path, n_pieces, nbest_scores (best first), nbest_changes and round_trip
    (each text's ids were decoded and gave the text; literal space marks in a text decode to spaces, as in the library).

    nbest_changes has for each of the N paths the places, in rising order, where it differs from the best: its ids
    stand for the n ids of the best path from position at. The first path's list is empty."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[a for a, _ in _ADDED]).withColumn("text", F.col("text").cast("string"))
    keep = [c for c in docs.columns if c != "text"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), _ADDED_DDL])
    return docs.mapInArrow(_encode(model, n, scores, keep), ddl)


def _decode(path: str, keep: list[str], column: str):
    def run(batches):
        pieces = _pieces(path, "model")  # decoding needs no scores
        for batch in batches:
            ids = batch.column(column)
            ids = ids.cast(pa.list_(pa.int32()))
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            texts = pieces.decode_all(offsets, ids.flatten().to_numpy(zero_copy_only=False))
            texts = texts.combine_chunks() if len(ids) else pa.array([], pa.string())
            texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, "text"])

    return run


def decoded(rows: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """All columns, and text: what the ids of a column decode to; null ids give null."""
    small_batches(rows.sparkSession)
    rows = rows.drop("text")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "text string"])
    return rows.mapInArrow(_decode(model, rows.columns, column), ddl)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
