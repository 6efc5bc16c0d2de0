"""Reports of tasks that share a passage don't meet in one group."""

import numpy as np

from lagweave.llm import suffix_dedup as sd


def test_reports_that_begin_with_one_hot_key_spread():
    buckets = []
    for task in range(200):
        key = np.repeat(np.array([5, 1000 + task], np.uint64), 2)
        doc = np.array([2 * task, 2 * task + 1] * 2, np.uint64) ^ np.uint64(1 << 63)
        rows = list(sd._merged_rows([[key, doc, np.zeros(4, np.uint64)]], 4, True))
        assert rows == list(sd._merged_rows([[key, doc, np.zeros(4, np.uint64)]], 4, True))
        buckets += [bucket for kind, bucket, *_ in rows if kind == 1]
    assert len(buckets) == 200 and max(buckets) < 0
    assert len(set(buckets)) > 190
