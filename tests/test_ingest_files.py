"""Members read from files, the quarantine beside them, and covariance from blocks."""

import numpy as np
import pytest

from signalharm.operators import covariance
from signalharm.sources import text as X


def test_files_of_all_kinds(spark, tmp_path):
    good = b"##NAMES=quartz\n##ID=R1\nx, y\n1, 2.5\n2, 3.5\n"
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.txt").write_bytes(good)
    (tmp_path / "crlf.txt").write_bytes(good.replace(b"\n", b"\r\n"))
    (tmp_path / "empty.txt").write_bytes(b"")  # not read
    (tmp_path / "blank.txt").write_bytes(b"\n")
    (tmp_path / "latin.txt").write_bytes(good + b"#Note=\xe9\n")
    (tmp_path / "cut.txt").write_bytes(good + b"3,\n")
    (tmp_path / "back.txt").write_bytes(good + b"0, 1\n")
    (tmp_path / "skipped.dat").write_bytes(good)
    files = X.read_members(spark, str(tmp_path), "*.txt")
    assert {r.member: r.n_bytes for r in files.collect()}["a.txt"] == len(good)
    out = str(tmp_path / "parsed")
    X.write_with_quarantine(X.parse_text_signals(files), out)
    kept = {r.member: (r.id, r.axis, r.y) for r in X.read_accepted(spark, out).collect()}
    assert kept == {m: ("R1", [1.0, 2.0], [2.5, 3.5]) for m in ("a.txt", "crlf.txt")}
    codes = {r.member: r.rejection_code for r in X.read_quarantine(spark, out).collect()}
    assert codes == {"blank.txt": "required_header_missing", "latin.txt": "not_text", "cut.txt": "bad_numeric_row", "back.txt": "axis_not_monotone"}


def test_written_members_come_back(spark, tmp_path):
    rows = [("m1", "a\nb"), ("s001-A01.csv", "1,2\n{}"), ("long", "0123456789" * 200_000)]
    X.write_members(spark.createDataFrame(rows, "member string, payload string"), str(tmp_path / "m"))
    got = {r.member: r.payload for r in X.read_members(spark, str(tmp_path / "m"), "*.txt").collect()}
    assert got == {m: p + "\n" for m, p in rows}


def test_members_of_any_name_in_few_folders(spark, tmp_path):
    odd = ["a:b/c %41+", "_x", ".y", "ü=1", "dup", "dup", None, "x.txt"]
    rows = [(m, f"p{i}") for i, m in enumerate(odd)] + [(f"m{i}", None if i % 2 else "v") for i in range(1500)]
    root = tmp_path / "m"
    X.write_members(spark.createDataFrame(rows, "member string, payload string").repartition(3), f"file://{root}")
    files = X.read_members(spark, str(root), "*.txt")
    want = sorted((m or X.NO_NAME, (p or "") + "\n") for m, p in rows)
    assert sorted((r.member, r.payload) for r in files.collect()) == want
    assert len(list(root.glob("*/*"))) < 12 and not list(root.glob("_*"))  # before, a folder and two files of each
    assert files.rdd.getNumPartitions() <= X.READERS * spark.sparkContext.defaultParallelism < len(rows) / 32
    with pytest.raises(FileExistsError):
        X.write_members(spark.createDataFrame(rows, "member string, payload string"), str(root))


def test_members_in_folders_of_their_own(spark, tmp_path):
    rows = [("m1", "a"), ("m2", "b")]
    spark.createDataFrame(rows, "member string, payload string").write.partitionBy("member").text(str(tmp_path / "m"))
    got = {r.member: r.payload for r in X.read_members(spark, str(tmp_path / "m"), "*.txt").collect()}
    assert got == {m: p + "\n" for m, p in rows}


def test_repeated_task_leaves_no_member_twice(tmp_path):
    for attempt in (1, 2):
        own = tmp_path / f"_0.{attempt}"
        (own / "1").mkdir(parents=True)
        (own / "1" / "a.txt").write_bytes(b"x\n")
        X._keep(str(own), str(tmp_path / "members-0"))
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.txt")] == ["members-0/1/a.txt"]


@pytest.mark.parametrize("held", [64, 1])
def test_covariance_against_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(covariance, "KEYS_HELD", held)
    rng = np.random.default_rng(8)
    groups = {"hot": rng.normal(100, 2, (300, 5)) @ np.diag([1, 2, 3, 4, 5]), None: rng.normal(-3, 1, (40, 5)), "same": np.ones((4, 5))}
    rows = [(k, [float(v) for v in r]) for k, g in groups.items() for r in g]
    rows += [("hot", None), ("hot", [1.0]), ("hot", [float("nan")] * 5), ("bad", [None] * 5)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(7)
    got = covariance.shrunk_covariance(df, ["k"], "v", 5).toPandas()
    assert set(got.k.where(got.k.notna(), None)) == set(groups)
    for k, x in groups.items():
        part = got[got.k.isna()] if k is None else got[got.k == k]
        n, p = x.shape
        c = x - x.mean(0)
        s = c.T @ c / n
        mu, norm = np.trace(s) / p, (s * s).sum()
        delta = (norm - p * mu * mu) / p
        beta = (((c * c).sum(1) ** 2).mean() - norm) / (p * n)
        shrinkage = min(max(beta, 0), delta) / delta if delta > 0 else 0.0
        want = (1 - shrinkage) * s + shrinkage * mu * np.eye(p)
        assert (part.n == n).all() and np.allclose(part.shrinkage, shrinkage, atol=1e-9)
        assert np.allclose(part.covariance, want[part.i - 1, part.j - 1], atol=1e-6)


def test_covariance_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, v array<double>")
    assert covariance.shrunk_covariance(none, ["k"], "v", 3).count() == 0
