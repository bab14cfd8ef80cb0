"""Workers are used again, so tasks return what they freed."""

from __future__ import annotations

import numpy as np
import psutil

from hintwise.llm import common, language_id, simhash


def test_tasks_hand_memory_back():
    def held() -> int:
        return psutil.Process().memory_info().rss >> 20

    many = [bytes(1000) for _ in range(200_000)]
    kept = [many[i] for i in range(0, len(many), 200_000 // 50)]  # freed blocks lie below blocks in use
    full = held()
    del many
    common.hand_back()
    assert len(kept) == 50 and held() < full - 100


def test_steps_of_the_pipeline_do(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id bigint, text string")
    assert language_id.hand_back is common.hand_back and simhash.hand_back is common.hand_back
    found = {r.doc_id: r.fp for r in simhash.fingerprints(texts).collect()}
    assert found[2] == 0 and np.uint64(found[1] & (1 << 64) - 1) == np.uint64(simhash.fingerprint("one two three four"))
