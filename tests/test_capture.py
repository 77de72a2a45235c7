import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.operators import project
from lumenquarry.sources import capture, files


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def video(n, fps, width=1920, height=1440):
    mdhd = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 600, n * 600 // fps))
    stts = box(b"stts", struct.pack(">IIII", 0, 1, n, 600 // fps))
    minf = box(b"minf", box(b"stbl", stts))
    tkhd = box(b"tkhd", b"\0" * 76, struct.pack(">II", width << 16, height << 16))
    trak = box(b"trak", tkhd, box(b"mdia", mdhd, box(b"hdlr", b"\0" * 8, b"vide", b"\0" * 12), minf))
    return box(b"ftyp", b"isom") + box(b"mdat", b"\1" * 999) + box(b"moov", box(b"mvhd", b"\0" * 100), trak)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "depth").mkdir()
    (tmp_path / "confidence").mkdir()
    rng = np.random.default_rng(1)
    for k in range(4):
        (tmp_path / "depth" / f"{k:06d}.png").write_bytes(files.png_bytes(rng.integers(0, 5000, (6, 8)).astype("u2")))
        (tmp_path / "confidence" / f"{k:06d}.png").write_bytes(files.png_bytes(rng.integers(0, 3, (6, 8)).astype("u1")))
    (tmp_path / "depth" / "notes.txt").write_text("odd")
    rows = [f"{k / 10}, {k}, 0, 0, {k}, 0, 0, 0, 2, 10, 10, 4, 3" for k in range(4)]
    (tmp_path / "odometry.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy\n" + "\n".join(rows) + "\n")
    (tmp_path / "imu.csv").write_text(",".join(capture.IMU) + "\n" + "\n".join(f"{k / 100},0,0,-9.8,0,0,0" for k in range(40)) + "\n")
    (tmp_path / "camera_matrix.csv").write_text("10,0,4\n0,10,3\n0,0,1\n")
    (tmp_path / "rgb.mp4").write_bytes(video(4, 10))
    return tmp_path


CONFIG = {"dataset": {"depth": {"width": 8, "height": 6}}}


def test_png_filters_and_damage():
    zlib = files.zlib
    x = np.random.default_rng(0).integers(0, 1 << 16, (5, 7)).astype("u2")
    rows = x.astype(">u2").view(np.uint8).reshape(5, -1).astype(int)
    packed = bytearray()
    for k, line in enumerate(rows):  # one row for each filter type
        up = rows[k - 1] if k else np.zeros(14, int)
        left, corner = np.concatenate([[0, 0], line[:-2]]), np.concatenate([[0, 0], up[:-2]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, near][k]
        packed += bytes([k]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    plain = files.png_bytes(x)
    at = plain.index(b"IDAT") - 4
    body = zlib.compress(bytes(packed))
    idat = struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body))
    assert (files.png_gray(plain[:at] + idat) == x).all()
    assert (files.png_gray(plain) == x).all()
    broken = bytearray(plain)
    broken[at + 12] ^= 1
    with pytest.raises(files.FormatError):
        files.png_gray(bytes(broken))


def test_capture_opens_and_joins(spark, folder):
    c = capture.Capture(spark, str(folder), CONFIG)
    assert c.frames().count() == 4
    assert c.pose(2)["qw"] == 1.0 and c.pose(2)["z"] == 2.0
    with pytest.raises(IndexError):
        c.pose(9)
    assert sorted(round(r["timestamp"], 2) for r in c.imu_window(1).collect()) == [0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.11, 0.12, 0.13, 0.14, 0.15]
    assert c.depth_sample(3).count() == 3
    assert files.listing(spark, c.path("depth_dir")).where("frame is null").count() == 1
    before = c.fingerprint()
    (folder / "imu.csv").write_text("x")
    after = c.fingerprint()
    assert {k for k in before if before[k] != after[k]} == {"imu"}
    with pytest.raises(capture.CaptureError, match="imu_invalid"):
        capture.Capture(spark, str(folder), CONFIG)


def test_inventory_names_what_is_wrong(spark, folder):
    (folder / "depth" / "000001.png").unlink()
    (folder / "depth" / "000000.png").write_bytes(b"nothing")
    (folder / "rgb.mp4").unlink()
    (folder / "camera_matrix.csv").write_text("10,0\n0,10\n")
    with open(folder / "odometry.csv", "a") as f:
        f.write("x, 9, 0, 0, 0, 0, 0, 0, 1, 10, 10, 4, 3\n0.9, 3, 0, 0, 0, 0, 0, 0, 1, 10, 10, 4, 3\n0.8, 6, 0, 0, 0, 0, 0, 0, 1, 11, 10, 4, 3\n")
    codes = {r["code"] for r in capture.Capture(spark, str(folder), CONFIG, strict=False).inventory().collect()}
    assert codes == {"depth_ids_missing", "depth_malformed", "confidence_count_mismatch", "rgb_missing", "camera_matrix_invalid", "odometry_malformed_rows", "odometry_duplicate_ids", "odometry_missing_ids", "odometry_timestamps", "intrinsics_vary"}


def test_streams_that_disagree_are_refused(spark, folder):
    (folder / "rgb.mp4").write_bytes(video(5, 10))
    with pytest.raises(capture.CaptureError, match="frame_counts_equal"):
        capture.Capture(spark, str(folder), CONFIG)


def test_overlays_replace_lists_and_merge_dicts():
    assert capture.overlaid({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}}) == {"a": {"b": 1, "c": [3]}, "d": 1}
    assert capture.config_hash({"a": 1, "b": 2}) == capture.config_hash({"b": 2, "a": 1})


def test_ply_round_trip(spark, tmp_path):
    rows = [(1.0, 2.0, 3.0, 1, 2, 255), (-1.0, 0.5, 0.25, 0, 0, 0)]
    df = spark.createDataFrame(rows, "x float, y float, z float, r int, g int, b int")
    assert files.write_ply(df, str(tmp_path / "a.ply")) == 2
    assert {tuple(r)[1:] for r in files.read_ply(spark, str(tmp_path / "a.ply")).collect()} == {r[:3] for r in rows}
    assert files.write_ply(df.limit(0).select(*"xyz"), str(tmp_path / "b.ply")) == 0
    assert files.read_ply(spark, str(tmp_path / "b.ply")).count() == 0


def test_back_projection_and_return(spark, folder):
    c = capture.Capture(spark, str(folder), CONFIG)
    near = project.back_projected(files.pixels(c.depth(), stride=2).join(c.odometry().select("frame", "fx", "fy", "cx", "cy"), "frame"), 0.001, 0.1, 6.0)
    want = {(k, v, u): x[v, u] for k in range(4) for x in [files.png_gray((folder / "depth" / f"{k:06d}.png").read_bytes())] for v in range(0, 6, 2) for u in range(0, 8, 2) if 100 <= x[v, u] <= 6000}
    got = near.collect()
    assert {(r["frame"], r["v"], r["u"]): r["raw"] for r in got} == want
    assert all(math.isclose(r["x"], (r["u"] - 4) * r["raw"] / 1000 / 10) for r in got)
    again = project.pixel_lookup(near.drop("v", "u", "raw"), files.pixels(c.depth()), "frame", 6, 8)
    assert again.where(F.abs(F.col("raw") / 1000 - F.col("z")) > 1e-9).count() == 0 and again.count() == len(got)


def test_poses_and_their_inverse(spark):
    s = math.sin(math.pi / 4)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 10.0, 0.0, 0.0, 0.0, 0.0, s, s)], ["x", "y", "z", "px", "py", "pz", "qx", "qy", "qz", "qw"])
    there = project.to_world(df, axes="opencv")
    assert [round(there.first()[a], 9) for a in "xyz"] == [8.0, 1.0, 3.0]
    back = project.to_world(there, "world_to_camera", "opencv").first()
    assert [round(back[a], 9) for a in "xyz"] == [1.0, 2.0, 3.0]
    assert [round(project.to_world(df).first()[a], 9) for a in "xyz"] == [12.0, 1.0, -3.0]
    n = (0.6, 0.0, 0.8)
    local = project.to_local(df, (1.0, 1.0, 1.0), n)
    assert round(local.first()["h"], 9) == 1.6
    assert [round(project.to_scene(local, (1.0, 1.0, 1.0), n).first()[a], 9) for a in "xyz"] == [1.0, 2.0, 3.0]


def test_plane_is_found_among_noise(spark):
    rng = np.random.default_rng(3)
    flat = np.column_stack([rng.uniform(-2, 2, (900, 2)), np.full(900, 0.5) + rng.normal(0, 0.003, 900)])
    noise = rng.uniform(-2, 2, (600, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.vstack([flat, noise])] + [(None, 1.0, 1.0)], "x double, y double, z double")
    r = project.ransac_plane(df, 0.02, up=np.array([0.0, 0.0, 1.0]))
    assert r["normal"][2] > 0.9999 and abs(r["d"] + 0.5) < 0.003 and 890 <= r["support"] <= 920
    assert project.ransac_plane(df, 0.02, least=5000) is None
    assert project.ransac_plane(df.limit(0), 0.02) is None
