"""The encoder merges a pre-token once, however often a batch holds it."""

import pyarrow as pa

from lexmill.operators import flat_words as fw
from lexmill.operators import tokens as tk


def test_repeated_pretokens_are_merged_once(monkeypatch):
    vocabulary = tk.Vocabulary(("<s>",), list(b" abc"), [(2, 3), (1, 5)])
    seen, merged = [], fw.merged
    monkeypatch.setattr(fw, "merged", lambda ids, sizes, *rest: (seen.append(len(sizes)), merged(ids, sizes, *rest))[1])
    lists = pa.array([[" ab", " c", " ab"], None, [], [" ab"] * 500], pa.list_(pa.string()))
    out = pa.chunked_array(list(tk.encoder(vocabulary).func(iter([lists])))).to_pylist()
    assert out == [[6, 1, 4, 6], None, [], [6] * 500]
    assert seen == [2]
