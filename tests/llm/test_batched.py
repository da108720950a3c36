"""Passes over many words or texts at once give what the passes over one give."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from gridloom.llm import pieces, token_orc

TEXTS = ["the cat sat on the mat\nand ran", "aaa### bbb### $$$ ab$$$", "naïve Größe 日本語 x\0y 🙂🙂 z", None, "", "  two  spaces ", "q" * 90 + " tail", "a\tb c\n\nd"]


def test_viterbi_of_many_words_equals_that_of_each():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = sorted({w for t in TEXTS if t for w in p.words(t)})
    for n in {len(w) for w in words}:
        same = [w for w in words if len(w) == n]
        assert p.viterbi_many(same) == [p.viterbi(w) for w in same]


def test_many_texts_encode_as_single_ones():
    path = public_tokenizers.path("piece_bpe_32k.model")
    a, b = pieces.Pieces(path), pieces.Pieces(path)
    counts, ids, best, changed = a.encode_all(pa.array(TEXTS, pa.string()), 4)
    for i, own in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        got = b.encode(TEXTS[i], 4)
        assert np.array_equal(own, got[0]) and (best[i], changed[i]) == got[1:3] and got[3]


def test_whole_texts_have_the_n_best_paths_of_their_whole_lattices():
    rng = np.random.default_rng(2)
    sylls = "an the er ou ti re st hea ble ing tion wh ☃ 漢".split()
    for scores in ("model", "zipf"):
        p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), scores)
        for _ in range(12):
            t = " ".join("".join(rng.choice(sylls, rng.integers(1, 4))) for _ in range(rng.integers(1, 300)))
            ids, best, changed, same = p.encode(t, 6)
            want = p.n_best(pieces.MARK + t.replace(" ", pieces.MARK), 6)
            assert same and np.allclose(best, [s for s, _ in want], rtol=0, atol=1e-5)
            score = {i: s for i, s in p.ids.values()}
            for path, (s, own) in zip([pieces.path_ids(ids.tolist(), c) for c in changed], want, strict=True):
                weight = [sum(p.unknown / len(chr(0x2603).encode()) if p.is_byte[i] else score[i] for i in x) for x in (path, own)]
                assert p.decode(path) == t and abs(weight[0] - s) < 1e-5 and abs(weight[1] - s) < 1e-5


def test_chunks_of_many_texts_equal_whole_texts():
    e = token_orc.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "a   b\n \nc  d", "\u3000 \u3000x y", "<|endoftext|> a b", "\x1c \x1c! z"]
    texts += ["one.\nTwo, three!!\nfour", "it's dogs' \"quoted\" a_b_ x1. 1,2 é. ß!\nß", "a\n\nb \nc\n d", "end.\n", "\nstart", "x'\ns 'll. 're", "naïve.… “q”, ok"]
    for t in (texts, texts[::-1], ["a b"], []):
        counts, ids = e.encode_all(pa.array(t, pa.string()))
        want = [e.whole(x or "").tolist() for x in t]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
