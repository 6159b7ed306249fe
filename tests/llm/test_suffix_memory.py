import pyarrow as pa

from tillroll.llm import suffixes


def test_few_texts_are_hashed_at_a_time(monkeypatch):
    """A batch of 2 MB is never laid out whole, and gives the same entries as its rows alone."""
    sizes, plain = [], suffixes.Suffixes.__init__
    monkeypatch.setattr(suffixes.Suffixes, "__init__", lambda self, data, at: (sizes.append(int(at[-1] - at[0])), plain(self, data, at))[1])
    texts = [f"{i} " + "".join(chr(97 + (i * j * j) % 26) for j in range(1000)) for i in range(2000)]
    left = pa.table({"doc_id": range(2000), "text": texts, "block": [0] * 2000})
    right = pa.table({"kind": [suffixes.SETTLED], "packed": [suffixes.pack((pa.array([1, 7]).to_numpy().copy(), pa.array([5, 6]).to_numpy().copy()))]})
    got = suffixes._cut(left, right)
    assert got.num_rows == 2000 and got.column("kept").to_pylist() == [t.encode() for t in texts]
    assert sizes and max(sizes) <= 1 << 18
