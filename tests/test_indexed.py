"""Lines by an index and point clouds by chunks: the same rows as whole files, and only the bytes asked for."""

import numpy as np
import pytest

from sparktally.sources import indexed


@pytest.fixture
def table(tmp_path):
    path = tmp_path / "rows.tsv"
    rows = [(f"k{i % 7}é", f"label {i}", "x" * (i % 50) * 20) for i in range(95)]
    path.write_text("".join("\t".join(r) + "\n" for r in rows[:-1]) + "\t".join(rows[-1]), encoding="utf-8")
    indexed.write_line_index(str(path))
    return str(path), rows


@pytest.fixture
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    indexed.register(spark)
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_line_index(table):
    path, rows = table
    data = open(path, "rb").read()
    offsets = [int(x) for x in open(path.replace(".tsv", ".lineidx")).read().split()]
    assert [data[a:].split(b"\t")[0].decode() for a in offsets] == [r[0] for r in rows]


@pytest.mark.parametrize("part", [1, 10, 1000])
def test_indexed_lines(pushdown, table, part):
    path, rows = table
    df = pushdown.read.format("indexed_lines").option("rowsPerPartition", part).load(path)
    key = lambda r: (r.row, r.key, *r.columns)
    want = [(i, *r) for i, r in enumerate(rows)]
    for where, keep in (("true", lambda r: True), ("row = 17", lambda r: r[0] == 17), ("row in (3, 90, 94, 500)", lambda r: r[0] in (3, 90, 94)), ("row > 20 and row <= 33", lambda r: 20 < r[0] <= 33), ("key = 'k3é'", lambda r: r[1] == "k3é"), ("key in ('k1é', 'no') and row >= 50", lambda r: r[1] == "k1é" and r[0] >= 50), ("row < 5 and columns[0] <> 'label 2'", lambda r: r[0] < 5 and r[2] != "label 2"), ("row is null", lambda r: False)):
        assert sorted(map(key, df.where(where).collect())) == [r for r in want if keep(r)], where


def counted(monkeypatch, path):
    """Counts the bytes read of one file."""
    total, plain = [0], indexed.opened

    class Counting:
        def __init__(self, name):
            self.file, self.mine = plain(name), name == path

        def read(self, n):
            out = self.file.read(n)
            total[0] += len(out) * self.mine
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    monkeypatch.setattr(indexed, "opened", Counting)
    return total


def test_only_the_bytes_asked_for(monkeypatch, table):
    path, rows = table
    size = [len("\t".join(r).encode()) + 1 for r in rows]

    def read(*filters):
        reader = indexed.LinesReader({"path": path, "rowsPerPartition": "10"})
        assert list(reader.pushFilters(list(filters))) == []
        total = counted(monkeypatch, path)
        out = [row for p in reader.partitions() for row in reader.read(p)]
        monkeypatch.undo()
        return out, total[0]

    out, n = read(indexed.EqualTo(("row",), 41))
    assert [r[0] for r in out] == [41] and n == size[41]
    out, n = read(indexed.In(("row",), (3, 4, 80)))
    assert [r[0] for r in out] == [3, 4, 80] and n == size[3] + size[4] + size[80]
    out, n = read(indexed.EqualTo(("key",), "k2é"))
    own = [i for i, r in enumerate(rows) if r[0] == "k2é"]
    assert [r[0] for r in out] == own and n <= sum(size[i] for i in own) + 64 * len(rows) < sum(size) / 2
    assert len(indexed.LinesReader({"path": path, "rowsPerPartition": "10"}).partitions()) == 10


def test_empty_table(pushdown, tmp_path):
    (tmp_path / "none.tsv").write_text("")
    indexed.write_line_index(str(tmp_path / "none.tsv"))
    assert pushdown.read.format("indexed_lines").load(str(tmp_path / "none.tsv")).count() == 0


PLY = "ply\nformat {}\ncomment made\nelement vertex {}\nproperty uchar red\nproperty float x\nproperty double y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"


@pytest.mark.parametrize("share,batch", [(1 << 30, 65_536), (500, 7)])
def test_point_clouds(spark, tmp_path, share, batch):
    indexed.register(spark)
    rng = np.random.default_rng(1)
    xyz = rng.integers(-100, 100, (300, 3)).astype(np.float32)
    np.savez(tmp_path / "a.npz", points=np.hstack([xyz, xyz]), xyz=xyz + 1)
    np.savez_compressed(tmp_path / "b.npz", xyz=xyz.astype(float), other=np.arange(3))
    np.savez(tmp_path / "c.npz", points=np.asfortranarray(xyz))
    np.savez(tmp_path / "empty.npz", points=np.zeros((0, 3)))
    (tmp_path / "d.ply").write_text(PLY.format("ascii 1.0", 300) + "".join(f"7 {x} {y} {z}\n" for x, y, z in xyz) + "3 0 1 2\n")
    for name, order in (("e.ply", "<"), ("f.ply", ">")):
        rows = np.zeros(300, [("r", "u1"), ("x", order + "f4"), ("y", order + "f8"), ("z", order + "f4")])
        rows["x"], rows["y"], rows["z"] = xyz.T
        (tmp_path / name).write_bytes(PLY.format("binary_little_endian 1.0" if order == "<" else "binary_big_endian 1.0", 300).encode() + rows.tobytes() + b"\x03\0\0\0\0\1\0\0\0\2\0\0\0")
    (tmp_path / "notes.txt").write_text("not a cloud")
    df = spark.read.format("point_clouds").option("bytesPerPartition", share).option("pointsPerBatch", batch).load(str(tmp_path))
    got = {}
    for r in df.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.i, r.x, r.y, r.z))
    want = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    assert set(got) == {"a.npz", "b.npz", "c.npz", "d.ply", "e.ply", "f.ply"} and all(sorted(v) == want for v in got.values())
    assert (df.rdd.getNumPartitions() > 20) == (share == 500)
    assert spark.read.format("point_clouds").load(str(tmp_path / "b.npz")).count() == 300


def test_a_cloud_without_its_array(spark, tmp_path):
    indexed.register(spark)
    np.savez(tmp_path / "x.npz", other=np.zeros((3, 3)))
    with pytest.raises(Exception, match="points"):
        spark.read.format("point_clouds").load(str(tmp_path)).count()
