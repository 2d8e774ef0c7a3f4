"""Edge cases of keys, locations and pair lists."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import maps, paths
from tidemark.operators import inventory
from tests.conftest import rows


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "s string").select(expression(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "location, path",
    [("example/path", "/example/path/"), ("/another/path/", "/another/path/"), ("s3://bucket/object-key", "/object-key/")],
)
def test_location_path(spark, location, path):
    frame = inventory.location_uris(spark.createDataFrame([(location,)], "location string"))
    row = frame.first()
    assert (row["scheme"], row["path"], row["error"]) == ("s3", path, None)
    assert row["key"] == ("bucket" if "bucket" in location else "") + path


def test_empty_location_is_an_error(spark):
    row = inventory.location_uris(spark.createDataFrame([("",)], "location string")).first()
    assert row["error"] and row["path"] is None and row["scheme"] is None


@pytest.mark.parametrize(
    "raw, path, file, directory",
    [
        ("", "", None, "/"),
        ("/", "", None, "/"),
        ("//", "/", None, "/"),
        (" a/ ", "a/", "a", "a/"),
        ("a/b/", "a/b/", "a/b", "a/b/"),
        ("/a", "a", "a", "a/"),
        ("/ a", "a", "a", "a/"),
        ("a//", "a//", "a/", "a//"),
        ("\t/a b /", "a b /", "a b", "a b /"),
    ],
)
def test_normal_forms(spark, raw, path, file, directory):
    row = inventory.normalize_keys(spark.createDataFrame([(raw,)], "raw_key string")).first()
    assert (row["path"], row["file"], row["dir"]) == (path, file, directory)
    assert (row["file_error"] is None) == (file is not None)


@pytest.mark.parametrize(
    "key, parent",
    [("ab", ""), ("a/b", "a/"), ("a/b/", "a/"), ("a/b/c", "a/b/"), ("/", "/"), ("//", "/"), ("/a", "/"), ("ab/", ""),
     ("a/", "/"), ("a//", "a/")],
)
def test_parent(spark, key, parent):
    assert one(spark, key, paths.parent_key) == parent


@pytest.mark.parametrize(
    "base, parts, expected",
    [
        ("/a", ["b"], "/a/b"),
        ("/a//", ["b", "", "c"], "/a/b/c"),
        ("/a/b", ["..", "c"], "/a/c"),
        ("/a", [".."], "/"),
        ("/a/b", [".."], "/a/"),
        ("/a", ["b/"], "/a/b/"),
        ("/", ["..", "a"], "/../a"),
        ("/a", ["."], "/a/"),
    ],
)
def test_resolve(spark, base, parts, expected):
    assert one(spark, base, lambda c: paths.resolve_key(c, *[F.lit(p) for p in parts])) == expected


def test_resolve_directory(spark):
    assert one(spark, "/a", lambda c: paths.resolve_directory(c, F.lit("b"))) == "/a/b/"
    assert one(spark, "/a/", lambda c: paths.resolve_directory(c)) == "/a/"


@pytest.mark.parametrize(
    "pairs, expected",
    [
        (["a", "1", "b", "2"], {"a": "1", "b": "2"}),
        (["a", "1", "b"], {"a": "1"}),
        (["a", "1", "a", "2"], {"a": "2"}),
        ([None, "1", "b", None], {"null": "1", "b": None}),
        ([], {}),
        (None, None),
    ],
)
def test_pairs(spark, pairs, expected):
    frame = spark.createDataFrame([(pairs,)], "p array<string>")
    assert frame.select(maps.pairs_to_map(F.col("p")).alias("m")).first()["m"] == expected


@pytest.mark.parametrize("key, name", [("b/snapshot.x.1/f", "x.1"), ("snapshot.x", None), ("a/b", None)])
def test_snapshot_name(spark, key, name):
    assert one(spark, key, paths.snapshot_name) == name


STORED = [
    ("d/", 0, "application/x-directory"),
    ("d/f", 7, "application/octet-stream"),
    ("bare", 0, "Application/X-Directory"),
    ("plain", 3, None),
]


@pytest.mark.parametrize(
    "key, expected",
    [
        ("d", (True, "directory", None, "not found")),
        ("/d/", (True, "directory", None, "not found")),
        ("d/f", (True, "file", 7, None)),
        ("bare", (True, "directory", None, "is a directory")),
        ("plain", (True, "file", 3, None)),
        ("none", (False, "none", None, "not found")),
        ("/", (True, "file", None, "not found")),
    ],
)
def test_key_status(spark, key, expected):
    stored = spark.createDataFrame(STORED, "key string, size long, content_type string")
    got = inventory.key_status(spark.createDataFrame([(key,)], "raw_key string"), stored)
    assert rows(got, "exists", "path_type", "length", "length_error") == [expected]


def test_children_and_parents(spark):
    keys = ["top", "a/", "a/f", "a/b/c/g", "a/f2"]
    stored = spark.createDataFrame([(k, 1, None) for k in keys], "key string, size long, content_type string")
    assert rows(inventory.list_children(stored, "/")) == [("a",), ("top",)]
    assert rows(inventory.list_children(stored, " /a")) == [("b",), ("f",), ("f2",)]
    assert rows(inventory.missing_parents(stored)) == [("a/b/",), ("a/b/c/",)]
    assert rows(inventory.delete_directory(stored, "a/b")) == [("a/b/c/g",)]
    asked = spark.createDataFrame([("/a/f",), ("a/f/",), ("gone",), ("/",)], "raw_key string")
    assert rows(inventory.delete_plan(asked, stored)) == [("a/f", "delete"), ("gone", "missing")]
    assert rows(inventory.delete_plan(asked, stored, ignore_missing=True)) == [("a/f", "delete")]


def _joins(node):
    children = [node.children().apply(i) for i in range(node.children().size())]
    return [node] * (node.nodeName() == "Join") + [j for c in children for j in _joins(c)]


def test_key_status_sends_keys_alone(spark):
    """Forms of a key are many times its length, so they are made where they are compared and not shuffled."""
    stored = spark.createDataFrame([*STORED, ("d//", 0, "application/x-directory")], "key string, size long, content_type string")
    asked = spark.createDataFrame([("d//",), ("/d/f/",), (" plain ",), (None,)], "raw_key string")
    got = inventory.key_status(asked, stored)
    (join,) = _joins(got._jdf.queryExecution().optimizedPlan())
    forms = join.children().apply(0).output()
    assert sorted(forms.apply(i).name() for i in range(forms.size())) == ["_bare", "raw_key"]
    assert rows(got) == [
        (" plain ", True, "file", 3, None),
        ("/d/f/", False, "none", 7, None),
        ("d//", True, "directory", None, "is a directory"),
    ]
