"""Connected components: results against a search, and how many rounds are planned."""

import random

import pytest

from donorlens.llm import components


def searched(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        todo = [n] if n not in out else []
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = n
                todo += near[x]
    return out


@pytest.fixture
def tables(monkeypatch):
    """Names of the tables written, in order."""
    names = []

    def recorded(df, name, write=components.written):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(components, "written", recorded)
    return names


def found(spark, links, member=None):
    out = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", member)
    rows = out.collect()
    assert len(rows) == len({r.node for r in rows})
    return out, {r.node: r.component for r in rows}


def test_stars_need_no_round(spark, tables):
    links = [(1, k) for k in range(2, 9)] + [(20, 10), (10, 30), (10, 20)]
    member, got = found(spark, links)
    assert got == searched(links) and tables == ["edges", "components"]
    tables.clear()
    assert found(spark, [], member)[1] == got and tables == ["edges", "components"]
    tables.clear()
    assert found(spark, [])[1] == {} and tables == ["edges", "components"]


def test_links_are_added_to_components(spark, tables):
    draw = random.Random(5)
    first = [(k, k + 1) for k in range(100, 110)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(25)] + [(7, 7), (-3, 5), (-9, -3)]
    more = [(105, 3), (200, 201), (201, 150), (110, 150)]
    member, got = found(spark, first)
    real = [(a, b) for a, b in first if a != b]
    assert got == searched(real) and tables.count("edges") > 1
    assert found(spark, more, member)[1] == searched(real + more)
