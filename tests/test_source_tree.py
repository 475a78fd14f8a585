import io
import os
import tarfile
import zipfile

import pytest

from loomspark.sources import files

TREE = {"a.py": "x = 1\n", "pkg/b.py": "é", "pkg/.git/config": "c", "node_modules/deep/c.js": "d", "notes.md": "# e", "bad.bin": b"\xff\xfe"}


@pytest.fixture
def folder(tmp_path):
    for name, content in TREE.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return tmp_path / "t"


def rows(df):
    return {(r.path, r.name, r.language, r.content) for r in df.collect()}


@pytest.mark.parametrize("at_once", ["1", "500"])
def test_folder(spark, folder, at_once):
    got = rows(files.read_source_tree(spark, f"file://{folder}", skip_dirs=".git,node_modules", files_per_task=at_once))
    assert got == {("a.py", "a.py", "python", "x = 1\n"), ("pkg/b.py", "b.py", "python", "é"), ("notes.md", "notes.md", "markdown", "# e")}
    assert {r[0] for r in rows(files.read_source_tree(spark, str(folder), skip_pattern="^pkg/", extensions="py,js"))} == {"a.py", "node_modules/deep/c.js"}


def test_skipped_files_are_not_opened(spark, folder):
    (folder / "broken.py").symlink_to(folder / "pkg")  # opening it raises
    (folder / "gone.py").symlink_to(folder / "nowhere")
    os.mkfifo(folder / "pipe.txt")  # opening it waits for ever
    got = rows(files.read_source_tree(spark, str(folder), extensions="md"))
    assert {r[0] for r in got} == {"notes.md"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.path for r in files.read_source_tree(spark, str(folder), skip_pattern="pipe|gone|broken").filter("path like 'pkg/b%' and name = 'b.py'").collect()] == ["pkg/b.py"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_archives_are_read_in_tasks(spark, tmp_path, kind):
    at = tmp_path / f"t.{kind}"
    if kind == "zip":
        with zipfile.ZipFile(at, "w") as z:
            for name, content in TREE.items():
                z.writestr(name, content)
    else:
        with tarfile.open(at, "w:gz" if kind.endswith("gz") else "w") as t:
            for name, content in TREE.items():
                data = content if isinstance(content, bytes) else content.encode()
                info = tarfile.TarInfo(f"./{name}")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    got = rows(files.read_source_tree(spark, f"file://{at}", skip_dirs=".git"))
    assert {r[0] for r in got} == {"a.py", "pkg/b.py", "node_modules/deep/c.js", "notes.md"}


def test_written_tree_comes_back(spark, tmp_path):
    df = spark.createDataFrame([("a/b.py", "1"), ("c.js", None)], "path string, content string")
    assert files.write_source_tree(df, f"file://{tmp_path}/w") == 2
    assert rows(files.read_source_tree(spark, f"file://{tmp_path}/w")) == {("a/b.py", "b.py", "python", "1"), ("c.js", "c.js", "js", "")}
    with pytest.raises(Exception, match="no such"):
        files.read_source_tree(spark, f"file://{tmp_path}/none").collect()
