"""Connected components against a plain union-find, on shapes that need many rounds of label propagation."""

import random

import pytest

from marlstone.llm.components import connected_components


def plain(links):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in top}


def path(nodes):
    return list(zip(nodes, nodes[1:]))


def shuffled(n, seed):
    nodes = list(range(n))
    random.Random(seed).shuffle(nodes)
    return nodes


@pytest.mark.parametrize(
    "links",
    [
        path([2, *range(10, 1010), 1]),  # the smallest label has to cross a region that another root has labelled
        path(shuffled(1000, 5)),
        path(list(range(300))) + path(shuffled(300, 2))[:40] + [(500, 501), (501, 500), (502, 502)] + [(600, x) for x in range(601, 700)],
    ],
)
def test_components_of_adverse_shapes(spark, links):
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = plain([x for x in links if x[0] != x[1]])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_no_links_have_no_components(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2), (2, None)], "a long, b long")).collect() == []
    got = connected_components(spark.createDataFrame([(2, 1, 5), (2, 1, 6), (None, 9, 5)], "a long, b long, node long")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1)}
