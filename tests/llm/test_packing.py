import random

import numpy as np

from weftgraph.llm import packing


def test_local_search_keeps_items_and_helps():
    rng = random.Random(4)
    for trial in range(30):
        sizes = np.array([rng.randint(1, 60) for _ in range(rng.randint(0, 60))], np.int64)
        bad = [[i] for i in range(len(sizes))]  # the worst start: one item a bin
        bins = packing.local_search([list(b) for b in bad], sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= 100 for b in bins)
        best = packing.local_search(packing.best_fit(sizes, 100), sizes, 100)
        assert all(sizes[b].sum() <= 100 for b in best)
        fewest = -(-int(sizes.sum()) // 100)
        assert len(best) <= max(fewest + 1, fewest * 1.12)
        assert len(bins) <= max(fewest + 2, fewest * 1.2)


def test_two_for_one_step():
    sizes = np.array([60, 30, 27, 35, 25, 13], np.int64)
    takes = packing._choices([1, 2], sizes)
    choice = packing._transfer(packing._choices([0, 5], sizes), takes, [s for s, _ in takes], 5)
    assert choice and sum(sizes[list(choice[0])]) - sum(sizes[list(choice[1])]) in range(1, 6)


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 2048, 2049, 5000, *range(1, 900, 13)])) for i in range(400)] + [(900, None), (901, 3), (901, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    out = packing.pack(df).collect()
    fills = {}
    for r in out:
        fills[r.container] = fills.get(r.container, 0) + r.n_tokens
    assert max(fills.values()) <= 2048
    total = sum(n or 0 for _, n in rows)
    assert sum(fills.values()) == total
    assert len(fills) <= -(-total // 2048) + 1
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, n in rows[:400]:
        got = sorted(by_doc.get(i, []), key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in got) == n and (n > 2048 or len(got) == (n > 0))
        assert [r.token_start for r in got] == [2048 * k for k in range(len(got))]
    report = packing.fill_report(packing.pack(df)).first()
    assert report.n_containers == len(fills) and report.fullest <= 2048


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).collect() == []
