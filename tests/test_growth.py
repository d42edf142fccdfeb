"""What a task gets must not follow the table: pairs of one owner, shards, streamed files."""

from __future__ import annotations

import glob
import random
import re
from collections import Counter
from itertools import combinations

import pytest

from weftgraph.operators import scoring
from weftgraph.plans import build_queries, catalog
from weftgraph.session import scratch_path


def links_of(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), f"c{rng.randrange(60)}") for _ in range(200)] + [(9, f"own{i}") for i in range(30)] + [(None, "c1"), (1, None), (7, "alone")]
    owned = {}
    for owner, name in rows:
        if owner is not None and name is not None:
            owned.setdefault(owner, set()).add(name)
    return spark.createDataFrame(rows, "owner_id long, name string"), Counter(p for names in owned.values() for p in combinations(sorted(names), 2))


@pytest.mark.parametrize("part, pairs", [(1_000, 2_000_000), (4, 50)])
def test_pairs_of_one_owner_are_dealt_to_tasks(spark, monkeypatch, part, pairs):
    monkeypatch.setattr(scoring, "PART", part)
    monkeypatch.setattr(scoring, "TASK_PAIRS", pairs)
    links, want = links_of(spark, 3)
    got = scoring.co_occurring(links)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, n) for (a, b), n in want.items())
    if pairs == 50:  # tasks follow the pairs, and one owner's pairs are in several of them
        assert got.rdd.getNumPartitions() > 4


@pytest.mark.parametrize("most", [1, 7, 100, 10_000])
def test_first_pairs_equal_the_sorted_list(spark, most):
    links, want = links_of(spark, 4)
    assert [tuple(r) for r in scoring.first_pairs(links, most).collect()] == sorted(want)[:most]


def test_no_task_numbers_a_whole_shard(spark, data):
    """Only joins and grouping by more than the graph: no rows are dealt by the graph alone."""
    plan = catalog.queries()["union_shards"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"hashpartitioning\(kg_id#\d+L?, \d", plan)


@pytest.mark.parametrize("name, limit", [("stream_edges", "FILE_ROWS"), ("stream_files", "FILE_BYTES")])
def test_streamed_files_grow_in_number_not_in_size(spark, data, monkeypatch, name, limit):
    monkeypatch.setattr(build_queries, limit, 500)
    made = []
    monkeypatch.setattr(build_queries, "scratch_path", lambda s, n: made.append(scratch_path(s, n)) or made[-1])
    rows = catalog.queries()[name](spark, data).count()
    assert rows > 0 and len(glob.glob(made[0].removeprefix("file://") + "/part-*")) >= 10
