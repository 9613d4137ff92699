"""Streams over a table that arrives in several micro-batches."""

from pyspark.sql import functions as F

from tokenloom.operators import delivery
from tokenloom.plans import streams


def test_better_copies_come_in_later_batches(spark, tmp_path, monkeypatch):
    counts = "input_tokens long, output_tokens long, cache_read long, cache_write_5m long, cache_write_1h long"
    # Of message k the copy of batch 3 has the most output; message j comes once, late.
    rows = [(i, i, "claude", "k", 1, 0, 10 * (i + 1), 0, 0, 0, 100) for i in range(4)] + [(4, 2, "codex", "j", 1, 1, 1, 1, 1, 1, 100), (5, 3, "codex", None, 1, 1, 1, 1, 1, 1, 100)]
    spark.createDataFrame(rows, f"seq long, batch_no long, source string, dedup_key string, dedup_rank int, {counts}, ts long").coalesce(1).write.parquet(f"{tmp_path}/usage_event.parquet")
    stored, accept = [], delivery.accept_batch
    monkeypatch.setattr(delivery, "accept_batch", lambda old, *a, **k: stored.append(old.count()) or accept(old, *a, **k))
    got = sorted(tuple(r) for r in streams.stream_dedup_replace(spark, str(tmp_path)).collect())
    assert got == [(3, "claude", 40), (4, "codex", 5), (5, "codex", 5)]
    assert len(stored) >= 2
    days = streams.stream_late_data(spark, str(tmp_path)).select("total", F.col("requests")).collect()
    assert [tuple(r) for r in days] == [(110, 6)]
