"""Rasters a few at a time."""

import pyarrow as pa

from folio.plans import derived


def test_rasters_are_drawn_a_few_at_a_time():
    n = 100
    frame = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([3] * n, pa.int32()), pa.array([300] * n, pa.int32()), pa.array([400] * n, pa.int32())], ["doc_id", "page_no", "width", "height"])
    made = list(derived._drawn(iter([frame])))
    assert max(b.nbytes for b in made) < 4 << 20 and sum(map(len, made)) == n and [x for b in made for x in b["doc_id"].to_pylist()] == list(range(n))
