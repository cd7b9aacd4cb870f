"""What the driver plans at once: every stage, scan and broadcast of a plan takes memory of it, however small the tables are."""

import numpy as np
import pytest

from tallyscope.llm import mixing, near_overlap, simhash
from tallyscope.llm.common import stage


@pytest.fixture
def staged(monkeypatch):
    """(label, tables that its plan reads) of each table written by the near stage and the mix."""
    seen = []

    def recorded(df, label):
        seen.append((label, df._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return stage(df, label)

    for module in (simhash, near_overlap, mixing):
        monkeypatch.setattr(module, "stage", recorded)
    return seen


def corpus(rng):
    rows = []
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for k in range(3):
            rows.append((3 * i + k, f"s{i % 4}", " ".join([*w, *[f"n{i}{k}"] * (k > 0)])))
    return rows


def test_no_table_is_planned_over_and_over_in_one_step(spark, staged):
    docs = spark.createDataFrame(corpus(np.random.default_rng(4)), "doc_id long, source string, text string")
    assert near_overlap.left_over(docs).count() == 80
    assert mixing.mixed_rows(docs).count() > 0
    assert max(n for _, n in staged) <= 6, staged
    assert {"large-star", "small-star", "line-bins", "line-rows"} <= {label for label, _ in staged}


def test_stars_take_no_round(spark, staged):
    links = [(c, 100 * c + i) for c in (1, 2, 3) for i in range(1, 9)]
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(links, "lo long, hi long")).collect()}
    assert got == {(hi, lo) for lo, hi in links} | {(lo, lo) for lo, _ in links}
    assert [label for label, _ in staged] == ["links"]


def test_components_of_random_links(spark):
    rng = np.random.default_rng(5)
    links = {tuple(sorted(map(int, rng.integers(-400, 400, 2)))) for _ in range(420)}
    links = [(a, b) for a, b in links if a != b] + [(500, 501), (500, 501), (501, 502)] + [(-700, x) for x in range(600, 660)]
    up = {x: x for pair in links for x in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = [tuple(r) for r in simhash.components(spark.createDataFrame(links, "lo long, hi long")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in up)
