"""A file costs the store no more calls than it needs."""

from collections import namedtuple

from sessionlake.sources import files


def test_a_folder_is_made_once_and_a_store_opened_once(tmp_path, monkeypatch):
    made, opened, real = [], [], files.open_uri

    class Store:
        def __init__(self, fs):
            self.fs = fs

        def create_dir(self, path, recursive):
            made.append(path)
            self.fs.create_dir(path, recursive=recursive)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    def open_uri(uri):
        opened.append(uri)
        fs, base = real(uri)
        return Store(fs), base

    monkeypatch.setattr(files, "open_uri", open_uri)
    row = namedtuple("Row", "folder stem value")
    rows = [row(f, s, f"{f} {s}") for f in ("a", "b") for s in ("1", "2", "3")]
    files.FileWriter(str(tmp_path), ".json").write(iter(rows))
    assert [m.rpartition("/")[2] for m in made] == ["a", "b"]
    folders = files.Folders({"path": str(tmp_path), "suffix": ".json", "whole": "true"})
    (share,) = folders.shares(folders.files([]))
    opened.clear()
    assert [v for b in folders.read(share) for v in b.column("value").to_pylist()] == [r.value + "\n" for r in rows] and len(opened) == 1
