"""Scans of mounted trees open what they list and nothing else."""

import os

import pytest

from veilscan.sources.files import mounted_contents, open_below, scan_files
from veilscan.sources.options import Options


@pytest.fixture
def tree(tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    for folder in (root / "a" / "b", outside):
        folder.mkdir(parents=True)
    for i in range(5):
        (root / "a" / f"{i}.txt").write_text(f"MRN: A12{i}")
        (outside / f"{i}.txt").write_text("never read")
    (root / "a" / "b" / "deep.txt").write_text("deep")
    (root / "a" / "b" / "pic.xyz").write_text("unknown")
    os.mkfifo(outside / "pipe.txt")  # opening it for a plain read would never end
    os.mkfifo(root / "pipe.txt")
    (root / "out").symlink_to(outside)
    (root / "loop").symlink_to(root)
    (root / "a" / "link.txt").symlink_to(outside / "0.txt")
    return root, outside


def test_links_are_listed_and_never_opened(spark, tree):
    root, outside = tree
    for f in outside.glob("*.txt"):
        os.utime(f, (1, 1))
    got = {os.path.relpath(r["location"], root): (r["status"], r["reason"], r["text"]) for r in scan_files(spark, str(root), Options.of({})).collect()}
    assert got == {f"a/{i}.txt": ("full", None, f"MRN: A12{i}") for i in range(5)} | {
        "a/b/deep.txt": ("full", None, "deep"), "a/b/pic.xyz": ("unsupported", "unsupported_file_format", None), "pipe.txt": ("excluded", "special_file_excluded", None),
        "out": ("excluded", "symlink_excluded", None), "loop": ("excluded", "symlink_excluded", None), "a/link.txt": ("excluded", "symlink_excluded", None),
    }
    assert all(os.stat(f).st_atime == 1 for f in outside.glob("*.txt"))


def test_a_capped_scan_opens_its_files_only(spark, tree):
    root, _ = tree
    for f in root.glob("a/*.txt"):
        os.utime(f, (1, 1), follow_symlinks=False)
    got = {os.path.relpath(r["location"], root): r["reason"] for r in scan_files(spark, str(root), Options.of({"max_files": 2})).collect() if r["location"] != "[coverage]"}
    assert got == {"a/0.txt": None, "a/1.txt": None}
    assert [os.stat(root / "a" / f"{i}.txt").st_atime == 1 for i in (2, 3, 4)] == [True] * 3


def test_what_became_a_link_is_left_out(spark, tree):
    root, outside = tree
    with pytest.raises(OSError):
        open_below(str(root), str(root / "out" / "0.txt"))
    with pytest.raises(OSError):
        open_below(str(root), str(root / "a" / "link.txt"))
    listed = spark.createDataFrame([(str(root / "a" / "0.txt"), 9), (str(root / "a" / "1.txt"), 4), (str(root / "out" / "1.txt"), 10), (str(root / "pipe.txt"), 0), (str(root / "none.txt"), 1)], "wanted string, listed long")
    assert {(os.path.basename(r["path"]), r["changed"]) for r in mounted_contents(listed, str(root), 100).collect()} == {("0.txt", False), ("1.txt", True)}
