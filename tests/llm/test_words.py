import numpy as np
import pyarrow as pa

from brute import WORD
from metricloom.llm import words as w


def test_words_and_borders():
    texts = ["one two", None, "", "tw", "o \t\x0b\n x  é\u00a0y", " ", "two"]
    found = w.words(pa.array(texts))
    raw = found.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(found.start, found.end)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    assert found.counts().tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert found.hash[1] == found.hash[-1] and len(set(found.hash.tolist())) == len(set(got))


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)) + " " + "x" * 500
    whole = w.words(pa.array([text, "w1 w2"]))
    monkeypatch.setattr(w, "PIECE_BYTES", 50)
    assert (w.words(pa.array([text, "w1 w2"])).hash == whole.hash).all()


def test_run_hashes_depend_on_order_only():
    v = np.array([5, 6, 7, 5, 6, 7, 6, 5], np.uint64)
    for second in (False, True):
        h = w.run_hashes(v, 3, second)
        assert h[0] == h[3] and len(set(h.tolist())) == 5
    assert len(w.run_hashes(v, 9)) == 0


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * i for i in range(50)] + [None])], ["t"])
    parts = list(w.slices(batch, "t", 100))
    assert sum(p.num_rows for p in parts) == 51 and len(parts) > 10
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column(0).to_pylist()
