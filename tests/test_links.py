"""Paths through links against a file system that has them."""

import os

from heliograph.sources.links import contained, resolved


def test_paths_lead_where_the_file_system_says(spark, tmp_path):
    root = str(tmp_path)
    for folder in ("real/a/b", "real/c", "other"):
        os.makedirs(f"{root}/{folder}")
    made = {"one": f"{root}/real/a", "real/a/up": "../c", "two": "one/b", "real/c/back": f"{root}/one", "loop": f"{root}/loop2", "loop2": f"{root}/loop/x", "out": "/usr/nowhere", "real/c/dots": "./.././c//back/up"}
    for name, target in made.items():
        os.symlink(target, f"{root}/{name}")
    links = spark.createDataFrame([(f"{root}/{n}", t) for n, t in made.items()] + [(None, "x"), (f"{root}/n", None)], "path string, target string")
    asked = ["one", "one/x", "two/y.txt", "one/up/z", "one/up/back/up/back/b/f", "real/c/dots/q", "loop/x", "out/p", "plain/file", "real//a/./b/../b", "onetwo", "two/../../c/f", "one/up/../a/b", "two/..", "..", "one/../../../../../../../../x", "/"]
    got = {r.path: r.real for r in resolved(spark.createDataFrame([(f"{root}/{a}",) for a in asked] + [(None,)], "path string"), links, 9).collect()}
    for a in asked:
        want = None if a.startswith("loop") else os.path.realpath(f"{root}/{a}")
        assert got[f"{root}/{a}"] == want, a
    roots = spark.createDataFrame([(f"{root}/two/..",), (f"{root}/loop",)], "root string")
    inside = {r.path: r.inside for r in contained(spark.createDataFrame([(f"{root}/{a}",) for a in asked], "path string"), roots, links, 9).collect()}
    head = os.path.realpath(f"{root}/two/..")
    assert {a for a in asked if inside[f"{root}/{a}"]} == {a for a in asked if not a.startswith("loop") and f"{os.path.realpath(f'{root}/{a}')}/".startswith(f"{head}/")}
    assert not inside[f"{root}/out/p"] and not inside[f"{root}/loop/x"] and not inside[f"{root}/onetwo"]
    assert contained(spark.createDataFrame([("/x/y",)], "path string"), spark.createDataFrame([("/",)], "root string"), links.limit(0)).first().inside
