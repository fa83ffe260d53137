"""The lots of the phrase counts: parts go when they are merged, and documents stay apart between slices."""

import numpy as np
import pyarrow as pa

from trawl.llm import collocations


def test_parts_go_when_merged():
    parts = [np.ones((4, 3), np.int32), np.zeros((4, 2), np.int32)]
    assert collocations.merged(parts).shape == (4, 5) and parts == []


def test_slices_keep_documents_apart(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 2)
    texts = ["a b", "c d e", "a b", None or "", "f", "a b"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["x", "x", "y", "x", "x", "x"]})
    got = {}
    for lang, words, found in collocations.of_batches([batch]):
        names = [w.decode() for w in words.code]
        got.setdefault(lang, []).extend(" ".join(names[c] for c in col if c) for col in found.T.tolist())
    assert sorted(got["x"]) == sorted(["a b", "b", "c d e", "d e", "e", "f", "a b", "b"]) and sorted(got["y"]) == ["a b", "b"]
