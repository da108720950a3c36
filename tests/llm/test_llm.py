"""Training-data operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, neardup, pages, pieces, secrets, suffixes, syncmers, token_orc, topk, toxicity

TOK = public_tokenizers.path("byte_bpe_50k.json")
TIK = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPM = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, label int"


def prose(n, seed):
    rng = np.random.default_rng(seed)
    sylls = "an the er ou ti re st hea ble ing tion wh".split()
    return " ".join("".join(rng.choice(sylls, rng.integers(1, 4))) for _ in range(n))


def rows():
    base = prose(120, 1)
    passage = prose(60, 2)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [base, base, near, None, "", " \n\t ", "one two", "ONE two", prose(90, 3) + " " + passage, passage + " " + prose(80, 4), "x" * 700, prose(4000, 5), "ß☃ 漢字  \n  x", "a  b   c \n\n d", base.upper(), prose(30, 6)]
    return [(i, t, "en", "s0" if i % 3 else "s1" if i else None, len(t or ""), "k", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*rows(), (None, "without an id", None, None, None, None, None), (0, prose(120, 1), "en", None, 3, "k", 0)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    token_orc.write_tokens(docs, str(tmp_path / "t"), TOK)
    got = [tuple(r) for r in token_orc.token_digest(token_orc.read_tokens(spark, str(tmp_path / "t"))).collect()]
    tok = Tokenizer.from_file(TOK)
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))] += 1
    assert Counter((a, c, d) for a, _, c, d in got) == want
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    token_orc.write_tokens(empty, str(tmp_path / "e"), TOK)
    assert token_orc.token_digest(token_orc.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_chunked_encoding_is_exact():
    e = token_orc.ChunkEncoder(TOK)
    for t in ["a  b", "a  \nb", " x\n \ny", "x   y  ", "it's  'll   b", "<|endoftext|> x", "\0 \0", "\x1c \x1c!", "tab\t x \t y", *(r[1] or "" for r in rows())]:
        assert e.encode(t).tolist() == e.whole(t).tolist() == e.encode(t).tolist()


def test_token_tails_are_looked_up_once_a_kind(monkeypatch):
    ends = [".", ",", '."', "!?", ")...", "!!!!!!!!", "~~~~~~~~~", "-" * 30, ""]
    texts = [" ".join(f"{w}{chr(97 + i % 26)}é{ends[(i + j) % 9]}" for j, w in enumerate(prose(300, i).split())) + "\nend.\n" for i in range(20)]
    encoder, asked, real = token_orc.ChunkEncoder(TOK), [], token_orc.ChunkEncoder._tails
    monkeypatch.setattr(token_orc.ChunkEncoder, "_tails", lambda self, tails: asked.append(sum(len(t) <= 8 for t in tails)) or real(self, tails))
    counts, ids = encoder.encode_all(pa.array(texts))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert max(asked) <= 10  # kinds of punctuation, not words


def test_lookup_reads_few_row_groups(spark, tmp_path):
    import os

    import pyarrow.orc

    path = str(tmp_path / "tokens")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' '), 30)").alias("text"))
    token_orc.write_tokens(docs, path, TOK)

    def scanned(ids):
        df = token_orc.lookup(spark, path, ids)
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().apply(0)
        return len(found), plan.metrics().apply("numOutputRows").value()

    n, rows_ = scanned([20_000])
    assert n == 1 and rows_ <= 1000 < 20_000  # one row group of one stripe of one file
    n, rows_ = scanned([20_001])  # in a row group's range, but in no Bloom filter (or, one time in a hundred, in one)
    assert n == 0 and rows_ in (0, 1000)
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert len(files) == 4 and all(pyarrow.orc.ORCFile(f"{path}/{f}").nrows for f in files)


def brute_components(docs_, k):
    sets, parent = {}, {}
    for i, t in docs_:
        w = (t or "").encode().lower().split()
        s = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def near_rows():
    """A group of near copies with links at all strengths, copies, and documents that share a passage."""
    rng = np.random.default_rng(4)
    words, passage, out = prose(60, 9).split(), prose(30, 10), []
    for i in range(60):
        w = list(words)
        for at in rng.integers(0, 60, rng.integers(0, 7)):
            w[at] = f"w{rng.integers(1000)}"
        out.append((i, " ".join(w)))
    out += [(100 + i, prose(12, 50 + i) + " " + passage) for i in range(25)]
    return [*out, *((200 + i, out[i % 3][1]) for i in range(9)), (300, None), (301, "")]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    data = near_rows()
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), k).collect()}
    assert got == brute_components(data, k)


def test_near_duplicates_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    monkeypatch.setattr(neardup, "CELL", 1 << 30)
    data = near_rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("dup_id", F.lit(1))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 4).collect()}
    assert got == brute_components(data, 4)
    kept = neardup.drop_duplicates(df, 4)
    assert kept.columns == df.columns and kept.count() == sum(i == c for i, c in got.items())


def test_near_duplicates_odd_rows(spark, docs, empty):
    out = [tuple(r) for r in neardup.near_duplicates(docs, 4).collect()]
    assert len(out) == docs.count() and (None, 1, None, True) in out
    by = {r[0]: r for r in out}
    assert by[2][2] == 0 and by[14][2] == 0 and by[7][2] == 6 and by[4][1:] == (0, 4, True) and by[6][1] == 1
    kept = neardup.drop_duplicates(docs, 5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15] and ids.count(None) == 1
    assert neardup.near_duplicates(empty, 4).count() == 0


def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[p : p + 200] for r in raws for p in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - 199):
            if n[r[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("max_group", [32_768, 40, 2])
def test_suffixes(spark, docs, empty, max_group):
    passage = prose(26, 8)
    more = spark.createDataFrame([(50 + i, prose(3 + i, 60 + i) + passage + prose(30, 90 + i) + ("=-" * (700 * i) if i < 6 else "")) for i in range(60)], "doc_id long, text string")
    all_ = [*docs.select("doc_id", "text").collect(), *more.collect()]
    want = Counter((r.doc_id, *w) for r, w in zip(all_, brute_repeats([r.text for r in all_]), strict=True))
    got = suffixes.drop_repeats(docs.select("doc_id", "text").union(more).repartition(3), max_group)
    assert Counter(map(tuple, got.collect())) == want
    assert suffixes.drop_repeats(empty).count() == 0


def test_suffixes_large_groups_do_not_multiply(spark, monkeypatch):
    rows_ = [(i, prose(40, 2 * i) + "the " * (60 + i % 7) + prose(40, 2 * i + 1)) for i in range(60)]
    want = Counter((r[0], *w) for r, w in zip(rows_, brute_repeats([t for _, t in rows_]), strict=True))
    tables, real = [], suffixes.written

    def counted(df, name):
        out = real(df, name)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(suffixes, "written", counted)
    got = suffixes.drop_repeats(spark.createDataFrame(rows_, "doc_id long, text string"), 8)
    assert Counter(map(tuple, got.collect())) == want
    places = dict(tables)["contexts"]  # and contexts: at most two rows an anchor
    assert sum(n for name, n in tables if name == "halves") < 8 * places


def test_very_long_runs_and_pieces(spark, monkeypatch):
    long = "x" * 3_000_000
    rows_ = [(0, long), (1, prose(300, 1) + "x" * 250), (2, prose(40, 2) + "-=" * 4000), (3, "-=" * 110 + prose(90, 3))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.drop_repeats(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    want = [(n, k, s) for n, k, s, _ in brute_repeats([t[:5000] if i == 0 else t for i, t in rows_])]
    assert got[0] == (3_000_000, 3_000_000, 1) and [got[i] for i in (1, 2, 3)] == want[1:]
    assert len(suffixes.anchors(long.encode())[0]) < 2000
    raw = (prose(3000, 4) + "ab" * 3000 + prose(900, 5)).encode()
    whole = suffixes.anchors(raw)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffixes.anchors(raw), strict=True))


def test_deep_shallow_sort():
    rng = np.random.default_rng(0)
    long = bytes(rng.integers(97, 100, 150, dtype=np.uint8))
    strings = [long[: rng.integers(60, 150)] + bytes(rng.integers(97, 99, rng.integers(0, 40), dtype=np.uint8)) for _ in range(200)] + [b"", b"a", b"a\0", b"a"]
    group = rng.integers(0, 3, len(strings))
    order, prefix, _ = suffixes.deep_shallow(group, strings)
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], strings[i]) for i in range(len(strings)))
    for r in range(1, len(order)):
        a, b = strings[order[r - 1]], strings[order[r]]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix[r] == (n if group[order[r - 1]] == group[order[r]] else -1)


def test_fingerprints(spark, plain, docs, empty):
    data = sorted(rows(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in syncmers.fingerprints(plain).collect()}
    for i, (doc_id, text, *_) in enumerate(data):
        own, nxt = text or "", data[(i + 1) % len(data)][1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + nxt[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.edited_fingerprint == syncmers.to_string(*syncmers.anchors(edited.encode()))
        assert r.near_next == syncmers.likeness(syncmers.anchors(own.encode()), syncmers.anchors(nxt.encode()))
    assert got[0].fingerprint == got[1].fingerprint and got[4].fingerprint == ""
    assert got[11].near_edited > 0.4 > got[11].near_next
    assert syncmers.fingerprints(docs).count() == docs.count() and syncmers.fingerprints(empty).count() == 0


def test_syncmers_by_definition():
    data = np.frombuffer(prose(80, 3).encode(), np.uint8)
    h = syncmers._smers(data).tolist()
    w = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(h) - w + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]
    assert syncmers.syncmer_places(data).tolist() == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    topk_rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1500)] + [(2000, None), (2050, [float("nan")] * 6), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1600, [0.5] * 6), (1650, [0.5] * 6)]
    df = spark.createDataFrame(topk_rows, "vec_id long, embedding array<double>")
    v = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 50 == 0).collect()}
    ids = [i for i, e in topk_rows if e and all(x is not None and x == x for x in e)]
    q = {i: np.floor(256 * np.array(e)).astype(int) for i, e in topk_rows if i in set(ids)}
    want = {}
    for i in ids:
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in ids if j != i))[:5]
            want |= {(i, r): (j, -s) for r, (s, j) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_numbers_is_exact(spark):
    base = [(0, [1e6, 1 / 256]), (1, [1e6 + 1 / 256, 1 / 256]), (2, [1e6 + 1 / 256, 2 / 256]), (3, [-1e6, 0.0]), (4, [1e38, 1e38]), (5, [1e38, 1.0000001e38]), (50, [-1e38, 1.0])]
    df = spark.createDataFrame(base, "vec_id long, embedding array<double>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    whole = {r.vec_id: [int(x) for x in r.v] for r in df.collect()}
    assert whole[1] == [256_000_001, 1] and whole[0] == [256_000_000, 1]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    for q in (0, 50):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q))[:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in best]


def test_top_k_in_many_groups_prunes_blocks(spark, monkeypatch):
    for name, value in (("PIVOT_ROWS", 100), ("GROUP_ROWS", 150), ("QUERY_CELL", 7), ("GROUPS_AT_ONCE", 5), ("BLOCK_ROWS", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    v = np.floor(256 * (centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 8)) * 0.2))
    v[:300] = v[7]  # a third of a group and more are the same
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    s = (v @ v.T).astype(int)
    for q in range(0, 2000, 50):
        best = sorted((-s[q, i], i) for i in range(2000) if i != q)[:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, -x) for x, i in best]
    _, scored, of = topk.search(np.arange(0, 2000, 50), v[::50], [None] * 40, np.arange(2000), v, 5)
    assert scored < 0.2 * of


def whole_lattice(p, s, n):
    return [(round(a, 6), len(i)) for a, i in p.n_best(pieces.MARK + s.replace(" ", pieces.MARK), n)]


def test_pieces():
    p = pieces.Pieces(SPM)
    for s in ["hello world", "a  b", "ß☃漢 x", "the erou tionhe", " lead", "tail ", "x"]:
        ids, scores, changes, same = p.encode(s, 4)
        assert same and p.decode(ids.tolist()) == s
        assert [round(x, 6) for x in scores] == [a for a, _ in whole_lattice(p, s, 4)]
        assert scores == sorted(scores, reverse=True) and len(changes) == len(scores)

    def every(s):  # all paths of a short string
        if not s:
            return [(0.0, 0)]
        out = [(p.ids[s[:k]][1] + a, n + 1) for k in range(1, len(s) + 1) if s[:k] in p.ids for a, n in every(s[k:])]
        return out or [(p.unknown + a, n + len(s[0].encode())) for a, n in every(s[1:])]

    for s in ["▁the", "▁erou", "▁ab☃"]:
        want = sorted((round(-a, 6) for a, _ in every(s)))[:5]
        assert [round(-a, 6) for a, _ in p.n_best(s, 5)] == want
        assert p.viterbi(s)[0] == pytest.approx(-want[0], abs=2e-6)
        assert len(want) < 2 or p.viterbi(s)[1] == pytest.approx(want[1] - want[0], abs=2e-6)


def test_pieces_on_rows(spark, docs, empty):
    out = pieces.encoded(docs, SPM).collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out) and {r.n_pieces for r in out if r.doc_id in (3, 4)} == {0}
    assert pieces.encoded(empty, SPM).count() == 0


def test_secrets(spark, docs, empty):
    t = "api_key = 'AbC123xyz+/Q99' AKIAABCDEFGH1234567 deadbeefdeadbeef00 password=short PassWord: hunter2hunter2"
    assert secrets.listed(secrets.base_spans(t)) == "assign:0:25,access:27:46,hex:47:65,assign:81:105"
    k = secrets.encoder(TIK)
    assert secrets.token_spans("see Zq8xV2mK9pL4rT7wY1bN now", k) == [(4, 3, 24)]
    for s in ["d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "getElementsByTagNameFromDocument", "1234567890123456789012", "internationalisation"]:
        assert secrets.token_spans(s, k) == []
    assert secrets.redact("ab SECRET cd", [(3, 0, 9), (5, 1, 8)]) == "ab [SECRET] cd"
    assert secrets.secret_spans(docs, TIK).count() == docs.count() and secrets.secret_spans(empty, TIK).count() == 0
    assert secrets.redacted(docs, TIK).schema == docs.schema


def test_mixing(spark, docs, empty):
    import math

    out = mixing.mix(docs, alpha=1.0).collect()
    assert mixing.mix(docs).columns == [*docs.columns, "copy_no", "shuffle_key"]
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    want = 0
    for r in docs.collect():  # alpha 1: every rate is 1
        i = "" if r.doc_id is None else str(r.doc_id)
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want += sum(u >= sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(40))
    assert len(out) == want
    assert mixing.mix(empty).count() == 0


def test_mixing_rate(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(df, weights={"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(10_000, rel=0.05) and n["b"] == pytest.approx(10_000, rel=0.05)


@pytest.mark.parametrize("rate", [0.01, 1.0, 50.0, 1_000.0, 2_048.0, 100_000.0])
def test_poisson_at_any_rate(spark, rate):
    import math

    parts = max(1, math.ceil(rate / mixing.PART))
    r = rate / parts
    got = spark.range(1).select(mixing.poisson_table(F.lit(r)).alias("t")).first().t
    exact = [math.exp(k * math.log(r) - r - math.lgamma(k + 1)) for k in range(math.ceil(r + 12 * r**0.5 + 25))]
    cumulative = np.cumsum(exact)
    assert cumulative[got.first - 1] < 1e-16 if got.first else True
    assert np.allclose(got.cumulative, cumulative[got.first : got.first + len(got.cumulative)], rtol=0, atol=1e-9)
    n = 4000 if rate < 5000 else 60
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("rate"), F.lit(2).alias("mixed"), F.lit(3).alias("cumulative"), F.lit(4).alias("mix_source"))
    if rate <= 50 or n == 60:
        out = mixing.mix(df, epochs=rate)
        assert out.columns == [*df.columns, "copy_no", "shuffle_key"]
        total = out.agg(F.count("*"), F.sum("mixed")).first()
        assert abs(total[0] - n * rate) < 5 * math.sqrt(n * rate) and total[1] == 2 * total[0]
    us = [int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(n)]
    if rate == 50.0:
        assert total[0] == sum(int(np.searchsorted(cumulative, u, side="right")) for u in us)


def test_toxicity(spark, docs, empty):
    data, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        words = prose(40, i).split()
        if bad:
            words[i % 40] = ["idiot", "grobl" + "abc"[i % 3], "scum", "1d10t"][(i // 6) % 4]
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d, la = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, la).collect()}
    held = [r for r in out.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    hit = [r.predicted == (r.doc_id % 6 == 0) for r in held]
    assert np.mean(hit) > 0.97 and all(0 <= r.score <= 1 for r in out.values())
    odd = toxicity.toxicity(docs, la.limit(0)).collect()
    assert len(odd) == docs.count() and {r.score for r in odd} == {0.0}
    assert toxicity.toxicity(empty, la).count() == 0 and toxicity.drop_toxic(docs, la).schema == docs.schema


def test_pages(spark):
    model = pages.train()
    ok = total = 0
    for page in pages.page_examples(60, 1234):
        nodes, blocks = pages.parse(page)
        for n in nodes:
            m = pages.LABEL.search(n.attrs)
            n.label = int(m[1]) if m else nodes[n.parent].label if n.parent >= 0 else 0
            n.attrs = pages.LABEL.sub("", n.attrs)
        odds = model.marginals(nodes)
        ok += sum((odds[i] >= 0) == (nodes[i].label == 1) for i, _ in blocks)
        total += len(blocks)
    assert ok / total > 0.97
    html = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  two<br>three.<p>Four, five.</article><footer>&copy; x</footer><scr'
    assert pages.main_text(html, model) == "A & B One two three. Four, five."
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", ""), (4, "w", "<script>x")], "page_id long, url string, html string")
    out = {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()}
    assert out[2] == out[3] == out[4] == ("", 0) and out[1][1] == len(out[1][0])
    assert pages.extract(df.limit(0)).count() == 0


LONG = "The river rose in the night, and by morning the lower fields stood under water. Nobody in the village had seen the like."
HAND_WRITTEN = [
    (f"<html><body><article><p>{LONG}</p></article></body></html>", LONG),
    ("<html><body><article><p>One sentence stands here alone.</p></article></body></html>", "One sentence stands here alone."),
    (f"<body><nav><a href=/>Home</a> <a href=/b>News</a></nav><article><p>One sentence, then.</p><p>{LONG}</p></article><footer>Imprint</footer>", f"One sentence, then. {LONG}"),
    (f"<body><article><p>{LONG}</p><pre>x = 1\ny = 2</pre><div class=comments><p>Great read, thanks!</p></div></article>", f"{LONG} x = 1 y = 2"),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG} {LONG}"),
    (f"<body><div class=qx7><p>{LONG}</p></div><div class=footer>Copyright</div></body>", LONG),
    (f"<body><div class=zz-top>{LONG} {LONG}</div>", f"{LONG} {LONG}"),
    (f"<body><header><h2>Site</h2></header><article><h1>Flood</h1><p>{LONG}</p><button>Subscribe now</button><p>More, later. {LONG}</p></article>", f"Flood {LONG} More, later. {LONG}"),
    (f"<body><article><p>{LONG} <button>Share</button></p></article><aside><ul><li><a href=x>Other</a></ul></aside>", LONG),
    (f"<body><main><h1>Title</h1><p>{LONG}</p><form>Mail <input><button>Send</button></form></main>", f"Title {LONG}"),
]


def test_hand_written_pages():
    model = pages.train()
    for html, want in HAND_WRITTEN:
        assert pages.main_text(html, model) == want, html


def test_messages_are_exact_marginals():
    model = pages.train(20, 3)
    nodes, _ = pages.parse(pages.page_examples(1, 8)[0])
    nodes = nodes[:9]
    odds = model.marginals(nodes)
    u = [sum(model.unary[i] * v for i, v in pages.node_features(n)) for n in nodes]
    weight = np.zeros((len(nodes), 2))
    for bits in range(2 ** len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        s = np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(model.pair[int(nodes[n.parent].tag in pages.FRAME), y[n.parent], y[i]] for i, n in enumerate(nodes) if i))
        for i, v in enumerate(y):
            weight[i, v] += s
    assert np.allclose(odds, np.log(weight[:, 1] / weight[:, 0]))


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        now = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
