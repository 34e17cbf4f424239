"""op8: suffixes sorted by their bytes, and runs that are found once and kept."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cases import prose

from feedloom.llm import repeats


@pytest.mark.parametrize("letters,limit", [(b"ab", 50), (b"\x00\xff", 50), (bytes(range(256)), 7), (b"a", 12)])
def test_equal_suffixes_of_a_segment_are_told(letters, limit):
    rng = random.Random(4)
    raw = bytes(rng.choice(letters) for _ in range(2000)) * 2
    starts = np.array([rng.randrange(len(raw) - limit) for _ in range(3000)])
    segment = np.sort(np.array([rng.randint(0, 20) for _ in starts]))
    order, same = repeats._sorted(np.frombuffer(raw, np.uint8), starts, segment, limit)
    keys = [(segment[k], raw[starts[k] : starts[k] + limit]) for k in order]
    assert order.tolist() == sorted(range(len(starts)), key=lambda k: (segment[k], raw[starts[k] : starts[k] + limit], k))
    assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]
    assert [len(x) for x in repeats._sorted(np.zeros(0, np.uint8), starts[:0], segment[:0], limit)] == [0, 0]


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    grams = np.sort(np.concatenate([rng.integers(0, 1 << 64, 1000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    assert (repeats._from_five(repeats._five(grams)) == grams >> np.uint64(24)).all()
    for kind in (np.uint16, np.uint32):
        x = rng.integers(0, np.iinfo(kind).max, 1000, kind)
        assert (repeats._from_planes(repeats._planes(x, x.itemsize), x.itemsize, kind) == x).all()


def test_the_runs_of_a_text_are_found_once(tmp_path, monkeypatch):
    """The passes behind the first one read them, and none hashes a text again."""
    import pyspark

    class Task:
        def taskAttemptId(self):  # noqa: N802
            return 7

    rng, passage = random.Random(2), prose(5, 60)
    texts = [prose(i, rng.randint(0, 50)) + passage[rng.randint(0, 99) :] * (i % 3) for i in range(200)] + ["", "é" * 200, "short"]
    texts += [texts[3], texts[7]]
    monkeypatch.setattr(repeats, "SLICE", 20_000)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Task())
    path, kept = f"file:{tmp_path}/texts.parquet", f"file:{tmp_path}/runs"
    ids = [None, *rng.sample(range(1000), len(texts) - 1)]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary())}), f"{tmp_path}/texts.parquet")
    want, slices = [], list(repeats._slices(path))
    for _, own, _, starts, ends, data in slices:
        anchor, first, last, gram, context = repeats.runs(data, starts, ends)
        doc = np.array(own, np.int64)[np.searchsorted(ends, first, side="right")]
        want.append((first, last, anchor - first, doc, list(zip(gram.tolist(), context.tolist(), strict=True))))
    assert len(slices) > 2
    shards = lambda *more: [pa.RecordBatch.from_arrays([pa.array([3]), pa.array([path]), *more], [str(i) for i in range(2 + len(more))])]
    sent = list(repeats._send(iter(shards()), 2, kept))
    assert sent and [x.name for x in (tmp_path / "runs").iterdir()] == ["3"]
    monkeypatch.setattr(repeats, "runs", None)
    for (first, last, place, doc, keys), (*_, own) in zip(want, repeats._known(path, kept, 3), strict=True):
        for a, b in zip((first, last, place, doc), own[:4], strict=True):
            assert a.tolist() == b.tolist()
        classes = {}
        for k, d in zip(keys, doc.tolist(), strict=True):
            classes[k] = min(d, classes.get(k, d))
        assert own[4].tolist() == [list(classes).index(k) for k in keys] and own[5].tolist() == list(classes.values())
    none = pa.array([[]], pa.list_(pa.binary()))
    assert list(repeats._contexts(iter(shards(none, none, none)), kept)) == []
    out = [r for b in repeats._kept(iter(shards(none, none)), kept) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out] == ids and any(r["n_removed"] for r in out)
