"""Shared helpers."""

import pyarrow as pa

from cohortroll.llm.common import bounded_sample, per_worker, text_slices, texts_of


def test_bounded_sample_has_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).repartition(5)
    for most in (0, 7, 500, 19_999, 20_000, 50_000):
        got = {r.id for r in bounded_sample(df, "id", most).collect()}
        assert got == {r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(most).collect()} and len(got) == min(most, 20_000)
    assert bounded_sample(df.limit(0), "id", 5).count() == 0


def test_slices_hold_every_row_once():
    texts = [None, "", "a" * 10, "b" * 3, "\xe9" * 4, "c", None, "d" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    slices = list(text_slices([batch, batch.slice(0, 0)], limit=12))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(8))
    assert all(s.num_rows == 1 or sum(len(t.encode()) for t in texts_of(s)) <= 12 for s in slices)
    assert [t for s in slices for t in texts_of(s)] == [t or "" for t in texts]


def test_worker_state_is_made_once():
    made = []
    assert per_worker(("test",), lambda: made.append(1) or 5) == per_worker(("test",), lambda: made.append(1) or 6) == 5
    assert made == [1]
