import pyarrow as pa

from tidewheel.llm.store import small_slices


def test_slices_are_small_and_whole():
    texts = ["a" * 10, None, "", "ž" * 30, "b" * 7, "c" * 8, "d", None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    got = list(small_slices(iter([batch, batch.slice(0, 0), batch.slice(4)]), "t", 15))
    assert [x for b in got for x in b.column("t").to_pylist()] == texts + texts[4:]
    assert [b.column("i").to_pylist() for b in got] == [[0, 1, 2], [3], [4, 5], [6, 7], [4, 5], [6, 7]]
