"""Frame folders with mixed, broken and empty files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from armada.sources import scan as S


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path, row_group_size=40, compression="none")


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "set/data/chunk-000"
    vectors = lambda n: pa.array([[float(i), None] for i in range(n)], pa.list_(pa.float32()))
    put(data / "file-000.parquet", episode_index=[0, 0, None], frame_index=[5, 6, 7], **{"observation.state": vectors(3)})
    put(data / "a +b%20 ü" / "episode_07.parquet", timestamp=[0.0, 0.1], action=pa.array([[[1.0], [2.0]], None], pa.list_(pa.list_(pa.float64()))))
    put(data / "file-001.parquet", episode_index=[3, 3], timestamp=[0.0, 0.1])  # no vectors
    put(data / "no_number.parquet", action=pa.array([[[1.0]]], pa.list_(pa.list_(pa.float64()))))
    put(data / "file-002.parquet", episode_index=pa.array([], pa.int64()), frame_index=pa.array([], pa.int64()))  # empty, but sound
    put(data / "file-003.parquet", episode_index=list(range(400)), frame_index=list(range(400)), **{"observation.state": vectors(400)})
    raw = bytearray((data / "file-003.parquet").read_bytes())
    for at in range(len(raw) // 2, len(raw) // 2 + 600):  # pages in the middle; the footer stays
        raw[at] ^= 0xFF
    (data / "file-003.parquet").write_bytes(bytes(raw))
    (data / "file-004.parquet").write_bytes(b"PAR1 not a table")
    (data / "file-005.parquet").write_bytes(b"")
    return tmp_path / "set"


def test_good_frames_and_an_issue_a_bad_file(spark, folder):
    frames, issues = S.scan(spark, str(folder))
    got = sorted((r["episode"], r["frame"], repr(r["observation.state"]), r["action"]) for r in frames.collect())
    assert got == [(0, 5, "[0.0, nan]", None), (0, 6, "[1.0, nan]", None), (7, 0, "None", [1.0, 2.0]), (7, 1, "None", None)]
    rows = {r["path"].rsplit("/", 1)[1]: r for r in issues.collect()}
    assert set(rows) == {"file-003.parquet", "file-004.parquet", "file-005.parquet"}
    assert all((r["severity"], r["rule"]) == ("warn", "parquet_read") and r["message"] for r in rows.values())


def test_folders_without_any_sound_file(spark, tmp_path):
    with pytest.raises(ValueError, match="no Parquet file"):
        S.scan(spark, str(tmp_path))
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a_1.parquet").write_bytes(b"x")
    frames, issues = S.scan(spark, str(tmp_path))
    assert frames.count() == 0 and issues.count() == 1


def opened(df):
    """The files that a plan reads."""
    return sorted({f.rsplit("/", 1)[1] for f in df.inputFiles()})


def test_first_episodes_open_their_files_alone(spark, tmp_path):
    for e in range(12):
        put(tmp_path / f"named/data/episode_{e * 3:06d}.parquet", action=[[float(e)]])
    df = S.read_first_episodes(spark, str(tmp_path / "named"), 2)
    assert opened(df) == ["episode_000000.parquet", "episode_000003.parquet"] and sorted(r["episode"] for r in df.collect()) == [0, 3]
    root = tmp_path / "listed"
    for i in range(4):
        put(root / f"data/chunk-001/file-{i:03d}.parquet", episode_index=[3 * i, 3 * i + 1, 3 * i + 2], action=[[0.0]] * 3)
    put(root / "meta/episodes/chunk-000/file-000.parquet", episode_index=list(range(12)), **{"data/chunk_index": [1] * 12, "data/file_index": [e // 3 for e in range(12)]})
    df = S.read_first_episodes(spark, str(root), 4)
    assert opened(df) == ["file-000.parquet", "file-001.parquet"] and sorted(r["episode"] for r in df.collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="no file"):
        S.read_first_episodes(spark, str(tmp_path / "none"), 2)
