"""What an operator keeps in a Python worker goes when another operator's task comes to that worker."""

import gc
import weakref

import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from gridloom.llm import neardup, pieces, secrets, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TIK = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROWS = {"doc_id": [1, 2], "id": [1, 2], "text": ["some plain words", None], "own": [None, None]}
OTHERS = {
    "toxicity": lambda: toxicity._cleaner(toxicity.Model()),
    "near_duplicates": lambda: neardup._signatures(5),
    "owners": lambda: neardup._owners(5),
    "bitmaps": lambda: neardup._bitmaps(5),
    "secrets": lambda: secrets._redactor(TIK, 2, None),
}


def kept_pieces(rows):
    """Runs two encoding tasks in this process; a weak reference to what they share."""
    ids = [pa.Table.from_batches(list(pieces._encode(MODEL, 4, "model", ["doc_id"])(iter([rows])))).column("ids").to_pylist() for _ in range(2)]
    own = pieces._pieces(MODEL, "model")
    assert ids[0] == ids[1] and own is pieces._pieces(MODEL, "model") and len(own.names) == 3
    return weakref.ref(own)


@pytest.mark.parametrize("other", OTHERS)
def test_other_stages_free_the_table_of_words(other):
    rows = pa.RecordBatch.from_pydict(ROWS, schema=pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("text", pa.string()), ("own", pa.list_(pa.int64()))]))
    before = kept_pieces(rows)
    assert sum(b.num_rows for b in OTHERS[other]()(iter([rows]))) > 0
    gc.collect()
    assert before() is None


def test_confirmation_and_fit_free_the_table_of_words():
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some plain words", None]})
    pairs = pd.DataFrame({"a": [1], "b": [2], "text_a": ["x y"], "text_b": ["x y"]})
    fitted = pd.DataFrame({"toxic": [1], "fold": [1], "text": ["x y"]})
    for run, frame in ((neardup._confirm(5), pairs), (toxicity._feature_rows({}, {}), fitted)):
        before = kept_pieces(rows)
        assert [len(f) for f in run(iter([frame]))] == [1]
        gc.collect()
        assert before() is None
