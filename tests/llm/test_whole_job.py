"""Cases that earlier versions of the operators and queries left out."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gridloom.llm import neardup, pieces, secrets, syncmers, token_orc, toxicity

TIK = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPM = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz234567", "abcdefghijklmnopqrstuvwxyz"])
@pytest.mark.parametrize("n", [20, 32, 40])
def test_random_lower_case_strings_are_secrets(alphabet, n):
    k, rng = secrets.encoder(TIK), np.random.default_rng(n)
    drawn = ["".join(rng.choice(list(alphabet), n)) for _ in range(300)]
    assert np.mean([secrets.token_spans(f"see {s} now", k) == [(4, 3, 4 + n)] for s in drawn]) > 0.97


def test_identifiers_of_words_are_no_secrets():
    k = secrets.encoder(TIK)
    for s in ["src/main/java/org/apache/Handler", "max_retry_count_per_host", "parseHTTPServerResponseCode2", "/usr/local/share/doc/x11/readme", "day-of-the-week-by-row"]:
        assert secrets.token_spans(s, k) == []
    assert secrets.identifier("/usr/lib/src/bin/doc/tmp/var", k) and not secrets.identifier("xqzv-kjwp-bnqx-zrtl", k)


def test_fingerprints_keep_every_syncmer(spark):
    rng = np.random.default_rng(7)
    passage, own, other = ("".join(rng.choice(list("abcdefghij klm"), n)) for n in (600, 9000, 9000))
    texts = [own[:4500] + passage + own[4500:], other[:2000] + passage + other[2000:]]
    marks = [syncmers.anchors(t.encode()) for t in texts]
    kmers = []
    for t, (hashes, places) in zip(texts, marks, strict=True):
        all_ = syncmers.syncmer_places(np.frombuffer(t.encode(), np.uint8)).tolist()
        first = {t[p : p + syncmers.K]: p for p in reversed(all_)}
        assert len(hashes) == len(first) > 64 and sorted(places.tolist()) == sorted(first.values())
        kmers.append(first)
    shared = len(kmers[0].keys() & kmers[1].keys())  # the passage's, in the same order in both
    want = shared / len(kmers[0].keys() | kmers[1].keys())
    assert shared > 40 and syncmers.likeness(*marks) == want
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[1].near_next == got[0].near_next == want and got[0].fingerprint == syncmers.to_string(*marks[0])


TEXTS = ["hello world", None, "", "a  b \n c", "☃ 漢字 🙂 x", " lead", "tail ", "▁marked▁ text", "q" * 90 + " tail"]


def test_round_trip_decodes_every_text(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    out = pieces.encoded(docs, SPM).persist()
    assert all(r.round_trip for r in out.collect())
    assert {r.doc_id: r.text for r in pieces.decoded(out, SPM).collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    assert [r.text for r in pieces.decoded(out.limit(1).selectExpr("cast(null as array<int>) as ids"), SPM).collect()] == [None]
    # A wrong segmentation of a word of covered characters must show.
    p = pieces.Pieces(SPM)
    hello, world = p.numbers(["▁hello", "▁world"])
    p.table.starts[hello], p.table.lengths[hello] = p.table.starts[world], p.table.lengths[world]
    assert p.encode("hello world")[3] is False
    monkeypatch.setattr(pieces, "_pieces", lambda *_: p)

    batch = pa.RecordBatch.from_pydict({"text": ["hello world", "world"]})
    assert next(pieces._encode(SPM, 4, "model", [])([batch])).column("round_trip").to_pylist() == [False, True]


def test_decoding_of_many_equals_that_of_each(monkeypatch):
    p = pieces.Pieces(SPM)
    ids = [p.encode(t)[0] for t in TEXTS]
    offsets = np.cumsum([0, *map(len, ids)])
    for size in (1, 7, 1 << 22):
        monkeypatch.setattr(pieces, "DECODE_IDS", size)
        assert p.decode_all(offsets, np.concatenate(ids).astype(np.int32)).to_pylist() == [p.decode(i.tolist()) for i in ids]


def test_voronoi_query_takes_all_labels(spark):
    from gridloom.plans import catalog

    d = "/root/testdata/sf0.001"
    lab = catalog.labelled(spark, d).toPandas()
    centres = lab.groupby("label")[["x", "y", "z"]].mean().sort_index()
    points = lab[["x", "y", "z"]].drop_duplicates().to_numpy()
    dist = np.sqrt(((points[:, None, :] - centres.to_numpy()[None]) ** 2).sum(axis=2))
    want = {tuple(p): (int(centres.index[i]), round(float(row[i]), 6)) for p, row, i in zip(points.tolist(), dist, dist.argmin(axis=1).tolist(), strict=True)}
    got = {(r.x, r.y, r.z): (r.label, r.dist) for r in catalog.QUERIES["centroid_voronoi_labels"](spark, d).collect()}
    assert got == want and centres.index.max() > 20 and {v[0] for v in got.values()} - set(range(21))


def test_all_n_best_paths_can_be_rebuilt(spark):
    texts = [*TEXTS, "the erou tionhe the erou"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    p = pieces.Pieces(SPM)
    score = {i: s for i, s in p.ids.values()}
    for r in pieces.encoded(docs, SPM).collect():
        text = texts[r.doc_id] or ""
        paths = [pieces.path_ids(r.ids, c) for c in r.nbest_changes]
        assert len(paths) == len(r.nbest_scores) and paths[0] == r.ids and len({tuple(x) for x in paths}) == len(paths)
        for ids, want in zip(paths, r.nbest_scores, strict=True):
            assert p.decode(ids) == text.replace("▁", " ")
            if not p.is_byte[ids].any():
                assert sum(score[i] for i in ids) == pytest.approx(want, abs=1e-6)
    assert max(map(len, (r.nbest_scores for r in pieces.encoded(docs, SPM).collect()))) == 4


def test_added_tokens_are_encoded_as_the_plain_library_call_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, e = Tokenizer.from_file(path), token_orc.ChunkEncoder(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|endoftext |> <|endof text|>", "plain text", None, *(f"c{i} d" for i in range(20))]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    counts, ids = e.encode_all(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want and want[0] == [64, 220, 50256, 275]


def test_masked_and_capital_words_are_always_counted():
    words, at = toxicity.Words({}, {}), toxicity.NAMES.index
    for w in ["1diot", "idio7", "4sshole", "idiot!", "l0ser", "i.d.i.o.t"]:
        got = toxicity.features(f"so {w} it is", words)
        assert got[at("masked")] > 0 and (w not in ("1diot", "l0ser") or got[at("masked_hits")] == 1)
    assert toxicity.features("you IDIOT man", words)[at("capital_words")] > 0
    rng = np.random.default_rng(3)
    for _ in range(20_000):
        t = "".join(rng.choice(list("aZé1@!*._- "), rng.integers(0, 9)))
        assert toxicity.may_mask(np.frombuffer(t.encode(), np.uint8)) or not toxicity.MASKED.search(t), t


def test_rows_that_share_a_doc_id_keep_the_first_text_and_empty_rows(spark):
    b, a = " ".join(f"b{i}" for i in range(30)), " ".join(f"a{i}" for i in range(30))
    data = [(1, ""), (1, b), (1, a), (2, b), (2, " \n"), (3, None), (3, "one two")]
    for rows in (data, data[::-1]):
        kept = neardup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, ""), (1, a), (2, " \n"), (3, ""), (3, "one two")]


def test_very_long_texts_go_through_every_operator(spark, tmp_path):
    from gridloom.llm import mixing

    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(90_000))  # over a megabyte
    texts = [long, long + " and a tail", "y" * 200_000, None, "short"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(2)
    chars = [len(t or "") for t in texts]
    scored = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(scored) == 5 and {r.score for r in scored} == {0.0}
    assert mixing.mix(docs, epochs=3.0).where("length(text) not in (5) and text is not null").agg({"doc_id": "count"}).first()[0] > 0
    token_orc.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: r for r in token_orc.read_tokens(spark, str(tmp_path / "t")).collect()}
    e = token_orc.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [tokens[i].ids for i in range(5)] == [[*e.whole(t or "").tolist(), 0] for t in texts]
    assert all(r.round_trip for r in pieces.encoded(docs, SPM).collect())
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert secrets.secret_spans(docs, TIK).count() == 5
    prints = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    assert [prints[i].n_chars for i in range(5)] == chars and prints[1].near_next > 0.99
