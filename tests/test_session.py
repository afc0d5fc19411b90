"""Small texts are committed in one step, whatever is cut off."""

import pytest

import vaultframe.session as session
from vaultframe.session import read_text, scratch_path, shared_dir, write_text


class Cut(Exception):
    pass


class CutFs:
    """A file system that stops before its n-th operation that changes something."""

    def __init__(self, fs, left):
        self.fs, self.left = fs, left

    def __getattr__(self, name):
        real = getattr(self.fs, name)
        if name not in ("create", "rename", "delete"):
            return real

        def call(*a):
            if self.left[0] == 0:
                raise Cut
            self.left[0] -= 1
            return real(*a)

        return call


def test_a_text_is_there_at_every_moment(spark, monkeypatch):
    path, file = scratch_path(spark, "texts") + "/log.json", session._file
    assert read_text(spark, path) is None
    for k in range(5):
        write_text(spark, path, str(k))
    cuts = 0
    for n in range(20):
        left = [n]
        monkeypatch.setattr(session, "_file", lambda s, p: (file(s, p)[0], CutFs(file(s, p)[1], left)))
        try:
            write_text(spark, path, f"new {n}")
            done = True
        except Cut:
            done, cuts = False, cuts + 1
        monkeypatch.setattr(session, "_file", file)
        assert read_text(spark, path) in ({f"new {n}"} if done else {"4", f"new {n}"} if n else {"4"})
        write_text(spark, path, "4")
        if done:
            break
    assert cuts >= 3


def test_a_torn_file_does_not_count(spark):
    path = scratch_path(spark, "texts") + "/log.json"
    write_text(spark, path, "first")
    target, fs = session._file(spark, f"{path}.000000002")
    out = fs.create(target, True)
    out.write(bytearray(b"0000"))
    out.close()
    assert read_text(spark, path) == "first"
    write_text(spark, path, "third")
    assert read_text(spark, path) == "third"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "a"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
