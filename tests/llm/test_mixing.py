import pytest

from quire.llm import mixing as M


def test_grants_fill_up():
    got = M.grants([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.0, 1)], {"a": 100, "b": 1000, "c": 10}, 1000)
    assert got["a"] == 100 and got["c"] == 30 and got["b"] == pytest.approx(870) and got["gone"] == 0
    assert M.grants([("a", 1.0, 2)], {}, 10) == {"a": 0.0}
    assert sum(M.grants([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 5, "b": 3}, 100).values()) == 8


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(3000)] + [(9001, None, 50), (9002, "other", 60), (9003, "small", 0), (9004, "big", None)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("small", 0.6, 3), ("big", 0.3, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    d = M.mix(sized, targets, buckets=16).collect()
    assert [r["position"] for r in d] == sorted(r["position"] for r in d) and 0 <= d[0]["position"] and d[-1]["position"] < 1
    uses = {}
    for r in d:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in uses.values())
    assert max(len(c) for (s, _), c in uses.items() if s == "small") <= 3 and max(len(c) for (s, _), c in uses.items() if s == "big") == 1
    share = {r["source"]: r for r in M.shares_report(sized, targets, buckets=16).collect()}
    total = sum(r["n_tokens"] for r in d)
    assert abs(total - sum(n or 0 for *_, n in rows)) < 100
    # absent's share goes to the others in proportion to their targets
    assert share["small"]["actual_share"] == pytest.approx(2 / 3, abs=0.01) and share["absent"]["tokens_used"] == 0
    assert {9001, 9002, 9003, 9004}.isdisjoint(r["doc_id"] for r in d)
    # the source of smaller documents on the whole comes earlier, and the weights change with time
    assert M.mix(sized.limit(0), targets).count() == 0
    assert M.mix(sized, targets.limit(0)).count() == 0


def test_buckets_change_nothing(spark):
    rows = [(i, "a" if i % 3 else "b", 5 + i % 11) for i in range(2000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    few, many = ([tuple(r) for r in M.mix(sized, targets, buckets=n).collect()] for n in (2, 64))
    assert few == many
