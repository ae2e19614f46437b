"""A library follows its folder: added, changed, renamed, copied, broken and deleted files."""

import pytest

from heliograph.plans.library import Library


def test_library(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "node_modules").mkdir(parents=True)
    files = {"a.txt": "alpha beta", "b.md": "beta gamma", "c.html": "<p>gamma delta</p>", "d.docx": "not a zip", "node_modules/e.txt": "alpha", "f.bin": "alpha"}
    for name, text in files.items():
        (root / name).write_text(text)
    first = Library.create(spark, str(tmp_path / "lib"))

    def holds(library, query):
        asked = spark.createDataFrame([(1, query)], "query_id long, query string")
        paths = {r.doc_id: r.path for r in library.records().where("not deleted").collect()}
        return sorted(paths[r.doc_id].rsplit("/", 1)[1] for r in library.index.search(asked).collect())

    one, report = first.index_folder(str(root), 1000.0)
    assert {r.status: r.n for r in report.collect()} == {"new": 4, "skipped: folder": 1, "skipped: type": 1}
    assert holds(one, "beta") == ["a.txt", "b.md"] and holds(one, "gamma") == ["b.md", "c.html"] and holds(first, "beta") == []
    s = one.status().first()
    assert (s.files, s.indexed, s.failed, s.deleted, s.chunks) == (4, 3, 1, 0, 3)
    assert "BadZipFile" in one.records().where("error is not null").first().error

    ids = {r.path.rsplit("/", 1)[1]: r.doc_id for r in one.records().collect()}
    (root / "a.txt").write_text("epsilon")
    (root / "b.md").rename(root / "moved.md")
    (root / "copy.txt").write_text("<p>gamma delta</p>")
    (root / "d.docx").unlink()
    two, report = one.index_folder(str(root), 2000.0)
    assert {r.status: r.n for r in report.where("status not like 'skip%'").collect()} == {"new": 1, "modified": 1, "renamed": 1, "unchanged": 1, "deleted": 1}
    assert holds(two, "beta") == ["moved.md"] and holds(two, "epsilon") == ["a.txt"] and holds(two, "gamma") == ["c.html", "copy.txt", "moved.md"]
    assert {r.path.rsplit("/", 1)[1]: r.doc_id for r in two.records().collect()}["moved.md"] == ids["b.md"]
    assert holds(one, "beta") == ["a.txt", "b.md"]  # a reader of the version before isn't disturbed
    assert [r.path.rsplit("/", 1)[1] for r in two.log().collect()] == ["d.docx"]
    again, report = two.index_folder(str(root), 3000.0)
    assert {r.status: r.n for r in report.where("status not like 'skip%'").collect()} == {"unchanged": 4}
    pure = again.purge()
    assert pure.status().first().deleted == 0 and holds(pure, "gamma") == ["c.html", "copy.txt", "moved.md"]
    with pytest.raises(RuntimeError):  # a writer who hasn't seen the newest version
        again.forget_folder(str(root))
    empty = pure.forget_folder(str(root))
    assert empty.status().first().files == 0 and holds(empty, "gamma") == []
    back, _ = empty.reindex_folder(str(root), 4000.0)
    assert holds(back, "gamma") == ["c.html", "copy.txt", "moved.md"]
