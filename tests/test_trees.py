"""Trees of any depth with cells of any type: round trips through XML and nested JSON, sorting, flat tables."""

import json

import pytest

from scanloom.sources import trees

ROWS = [
    ("a", 1, None, 0, "root", {"mass": 10.5, "label": "x < y & \"z\""}),
    ("a", 2, 1, 0, "group", {"mass": "12", "ok": True, "none": None}),
    ("a", 3, 1, 1, "leaf", {"mass": 9, "list": [1, "two", {"three": 3}]}),
    ("a", 4, 2, 0, "deep", {"mass": 100, "text": "007", "naïve": "漢字\nline"}),
    ("a", 5, 2, 1, "deep", {}),
    ("a", 6, 4, 0, "deeper", {"mass": "heavy"}),
    ("b", 1, None, 0, "single", {"n": -0.25}),
]


@pytest.fixture
def nodes(spark):
    rows = [(t, i, p, k, n, json.dumps(c)) for t, i, p, k, n, c in ROWS]
    return trees.nodes(spark.createDataFrame(rows, "tree string, id long, parent long, place int, name string, cells string").repartition(3))


def plain(df):
    return {(r["tree"], r["id"]): (r["parent"], r["place"], r["name"], json.loads(r["cells"].toJson())) for r in df.collect()}


WANT = {(t, i): (p, k, n, c) for t, i, p, k, n, c in ROWS}


def test_xml_round_trip(spark, nodes, tmp_path):
    assert plain(nodes) == WANT
    trees.write_xml(nodes, str(tmp_path / "x"))
    assert plain(trees.read_xml(spark, str(tmp_path / "x"))) == WANT


def nest(tree, i):
    t, _, _, _, n, c = next(r for r in ROWS if r[0] == tree and r[1] == i)
    kids = sorted((r for r in ROWS if r[0] == tree and r[2] == i), key=lambda r: r[3])
    return {"name": n, "cells": c, "children": [nest(tree, k[1]) for k in kids]}


def test_nested_json_round_trip(spark, nodes):
    got = trees.nested_json(nodes)
    assert {r["tree"]: json.loads(r["json"]) for r in got.collect()} == {"a": nest("a", 1), "b": nest("b", 1)}
    again = trees.from_nested_json(got)
    assert {r["tree"]: json.loads(r["json"]) for r in trees.nested_json(again).collect()} == {"a": nest("a", 1), "b": nest("b", 1)}
    assert sorted(r["id"] for r in again.where("tree = 'a'").collect()) == [1, 2, 3, 4, 5, 6]
    assert trees.nested_json(nodes.limit(0)).collect() == [] and trees.from_nested_json(got.limit(0)).collect() == []


def test_dynamic_cells_sort_as_numbers(spark):
    cells = [{"v": 10}, {"v": "9"}, {"v": 2.5}, {"v": "b"}, {}, {"v": "a"}, {"v": None}]
    rows = [("t", 0, None, 0, "r", "{}")] + [("t", i + 1, 0, i, str(i), json.dumps(c)) for i, c in enumerate(cells)]
    df = trees.nodes(spark.createDataFrame(rows, "tree string, id long, parent long, place int, name string, cells string"))
    order = [r["name"] for r in trees.sorted_places(df, "v").where("parent = 0").orderBy("place").collect()]
    assert order == ["2", "1", "0", "5", "3", "4", "6"]


def test_flat_table(spark, nodes):
    got = trees.flat_table(nodes, ["mass", "ok"], {"mass": "Mass (Da)"}).where("tree = 'a'").orderBy("number").collect()
    assert [(r["number"], r["level"], r["name"], r["Mass (Da)"], r["ok"]) for r in got] == [
        ("1", 1, "root", "10.5", None), ("1.1", 2, "group", "12", "true"), ("1.1.1", 3, "deep", "100", None), ("1.1.1.1", 4, "deeper", "heavy", None), ("1.1.2", 3, "deep", None, None), ("1.2", 2, "leaf", "9", None),
    ]
