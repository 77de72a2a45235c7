"""A capture folder as lazy DataFrames (S3 to S5, S8, S9, S13), its reports (C10 to C12) and fingerprint."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean
from . import files

# Column names of the capture's tables.
ODOMETRY = ["timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy"]
ODOMETRY_OPTIONAL = ["distortion_center_x", "distortion_center_y"]
IMU = ["timestamp", "a_x", "a_y", "a_z", "alpha_x", "alpha_y", "alpha_z"]

#: Names of a capture's files; a config's dataset.files replaces them.
NAMES = {"depth_dir": "depth", "confidence_dir": "confidence", "rgb": "rgb.mp4", "odometry": "odometry.csv", "camera_matrix": "camera_matrix.csv", "imu": "imu.csv"}


class CaptureError(ValueError):
    """A capture that can't be used."""


def overlaid(base: dict, over: dict) -> dict:
    """Base with the values of over; dicts are merged at every depth, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = overlaid(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(*paths: str) -> dict:
    """A YAML or JSON file with overlays, from left to right; a file that isn't there is an error."""
    out: dict = {}
    for p in paths:
        with open(p) as f:
            if p.endswith(".json"):
                part = json.load(f)
            else:
                import yaml

                part = yaml.safe_load(f)
        out = overlaid(out, part or {})
    return out


def config_hash(config: dict) -> str:
    """SHA-256 of the config as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV's columns as strings, with names and values trimmed."""
    df = clean.trimmed(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
    return df


def odometry(spark: SparkSession, path: str, tolerance: float | None = 1e-3) -> DataFrame:
    """Poses whose required values are finite, in the file's types.

    Frames that aren't integers and focal lengths that aren't positive are errors, optical centres that aren't a warning; with a tolerance, quaternions are
    brought to unit length.
    """
    raw = clean.require(raw_table(spark, path), ODOMETRY)
    columns = ODOMETRY + [c for c in ODOMETRY_OPTIONAL if c in raw.columns]
    good = clean.well_formed(clean.numbers(raw, columns), ODOMETRY)
    state = good.agg(F.coalesce(F.max(F.col("frame") != F.rint("frame")), F.lit(False)).alias("odd"), F.min(F.least("fx", "fy")).alias("focal"), F.min(F.least("cx", "cy")).alias("centre")).first()
    if state["odd"]:
        raise CaptureError(f"{path}: a frame isn't an integer")
    if state["focal"] is not None and state["focal"] <= 0:
        raise CaptureError(f"{path}: a focal length isn't positive")
    if state["centre"] is not None and state["centre"] <= 0:
        warnings.warn(f"{path}: an optical centre isn't positive", stacklevel=2)
    if tolerance is not None and state["focal"] is not None:
        good = clean.unit_quaternions(good, ("qx", "qy", "qz", "qw"), tolerance)
    return good.withColumn("frame", F.col("frame").cast("long"))


def odometry_quality(spark: SparkSession, path: str) -> DataFrame:
    """D3: one row: rows, malformed rows, frames given twice, frames missing from 0 on."""
    raw = clean.numbers(clean.require(raw_table(spark, path), ODOMETRY), ODOMETRY)
    good = clean.well_formed(raw, ODOMETRY).withColumn("frame", F.col("frame").cast("long"))
    twice = clean.duplicate_keys(good, ["frame"]).agg(F.array_sort(F.collect_list("frame")).alias("duplicate_frames"))
    gone = clean.missing_keys(good, "frame", 0).agg(F.array_sort(F.collect_list("frame")).alias("missing_frames"))
    counts = raw.agg(F.count("*").alias("rows")).crossJoin(good.agg(F.count("*").alias("good")))  # one row each
    return counts.select("rows", (F.col("rows") - F.col("good")).alias("malformed")).crossJoin(twice).crossJoin(gone)


def imu(spark: SparkSession, path: str) -> DataFrame:
    """The IMU's samples; columns that aren't there are an error, values that aren't numbers are null."""
    return clean.numbers(clean.require(raw_table(spark, path), IMU), IMU)


def camera_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    """The 3 x 3 matrix of a CSV without a header; another shape is an error."""
    rows = [[float(x) for x in r] for r in spark.read.csv(path, ignoreLeadingWhiteSpace=True).limit(4).collect()]
    if len(rows) != 3 or any(len(r) != 3 for r in rows):
        raise CaptureError(f"{path}: the camera matrix isn't 3 x 3")
    return rows


def exists(path: str) -> bool:
    fs, inner = files.filesystem(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows of one file with their places (row) and one group (all)."""
    return rows.withColumns({"row": F.monotonically_increasing_id(), "all": F.lit(1)})


class Capture:
    """A folder whose tables are lazy DataFrames. With strict, errors of the inventory or the streams' checks refuse it."""

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None, strict: bool = True) -> None:
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or {}
        self.names = NAMES | self.config.get("dataset", {}).get("files", {})
        size = self.config.get("dataset", {}).get("depth", {"width": 256, "height": 192})
        self.shape = (size["height"], size["width"])
        if strict:
            if errors := [(r["code"], r["message"]) for r in self.inventory().where("severity = 'error'").collect()]:
                raise CaptureError(f"{folder}: {errors}")
            if failed := [r["check"] for r in self.synchronization().where("not ok").collect()]:
                raise CaptureError(f"{folder}: streams disagree: {failed}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{self.names[name]}"

    def odometry(self) -> DataFrame:
        return odometry(self.spark, self.path("odometry"), self.config.get("inventory", {}).get("quaternion_norm_tolerance", 1e-3))

    def imu(self) -> DataFrame:
        return imu(self.spark, self.path("imu"))

    def depth(self) -> DataFrame:
        return files.frames(self.spark, self.path("depth_dir"), self.shape, 16)

    def confidence(self) -> DataFrame:
        return files.frames(self.spark, self.path("confidence_dir"), self.shape, 8)

    def frames(self) -> DataFrame:
        """Poses beside depth and, where there is one, confidence."""
        seen = self.odometry().join(self.depth().drop("path"), "frame")
        return seen.join(self.confidence().select("frame", F.col("raw").alias("confidence")), "frame", "left") if exists(self.path("confidence_dir")) else seen

    def pose(self, frame: int) -> dict:
        """The pose of a frame; an unknown frame is an IndexError."""
        row = self.odometry().where(F.col("frame") == frame).first()
        if row is None:
            raise IndexError(f"no frame {frame}")
        return row.asDict()

    def intrinsics(self, frame: int) -> dict:
        """The focal lengths and optical centre of a frame; an unknown frame is an IndexError."""
        pose = self.pose(frame)
        return {k: pose[k] for k in ("fx", "fy", "cx", "cy")}

    def frame(self, frame: int) -> dict:
        """Pose, depth and, where there is one, confidence of a frame; an unknown frame is an IndexError."""
        row = self.frames().where(F.col("frame") == frame).first()
        if row is None:
            raise IndexError(f"no frame {frame}")
        return row.asDict()

    def each_frame(self, frames: list[int] | None = None) -> Iterator[dict]:
        """Frames in their order, one at a time; all of them, or those that are asked for."""
        rows = self.frames() if frames is None else self.frames().where(F.col("frame").isin(frames))
        return (r.asDict() for r in rows.orderBy("frame").toLocalIterator())

    def imu_window(self, frame: int, seconds: float = 0.05) -> DataFrame:
        """Samples within seconds of a frame's time, both ends included."""
        t = self.pose(frame)["timestamp"]
        return self.imu().where(F.col("timestamp").between(t - seconds, t + seconds))

    def depth_ids(self) -> DataFrame:
        return files.listing(self.spark, self.path("depth_dir")).where("frame is not null").select("frame")

    def depth_sample(self, n: int = 5) -> DataFrame:
        """C11: least, largest, zero samples and shape of up to n frames at evenly spaced ranks, cut to whole ones; only these
        are decoded. A frame that can't be read has its problem and nothing else."""
        ids = self.depth_ids()
        many = ids.count()
        ranks = sorted({int(x) for x in np.linspace(0, many - 1, min(n, many))}) if many else []
        places = ids.withColumn("rank", F.row_number().over(Window.orderBy("frame")) - 1).where(F.col("rank").isin(ranks))  # a folder's names
        wanted = [r.frame for r in places.collect()]
        chosen = self.spark.read.format("binaryFile").load(self.path("depth_dir")).where(files.frame_id(F.col("path")).isin(wanted))
        rows = []
        for r in chosen.select(files.frame_id(F.col("path")).alias("frame"), "content").collect():  # n frames at most
            try:
                x = files.png_gray(bytes(r["content"]))
                if x.dtype != np.uint16:
                    raise files.FormatError(f"frame {r['frame']}: samples are {x.dtype}")
                rows.append((r["frame"], int(x.min()), int(x.max()), int((x == 0).sum()), x.shape[0], x.shape[1], str(x.dtype), None))
            except files.FormatError as e:
                rows.append((r["frame"], None, None, None, None, None, None, str(e)))
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "frame long, least int, largest int, zeros int, height int, width int, dtype string, problem string")

    def inventory(self) -> DataFrame:
        """Severity, code and message of what is wrong or worth a note; a capture is valid without errors."""
        found: list[tuple[str, str, str]] = []
        note = lambda severity, code, message="": found.append((severity, code, message))
        if not exists(self.folder):
            note("error", "scan_missing", self.folder)
        else:
            self._images(note)
            self._tables(note)
        return self.spark.createDataFrame(found, "severity string, code string, message string")

    def _images(self, note) -> None:
        n_depth = 0
        if not exists(self.path("depth_dir")):
            note("error", "depth_dir_missing", self.path("depth_dir"))
        else:
            ids = self.depth_ids()
            ends = ids.agg(F.count("*").alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
            n_depth = ends.n
            if not n_depth:
                note("error", "depth_empty")
            else:
                if ends.lo:
                    note("warning", "depth_not_zero_based", str(ends.lo))
                if gone := [r.frame for r in clean.missing_keys(ids, "frame", None).orderBy("frame").limit(10).collect()]:
                    note("error", "depth_ids_missing", str(gone))
                sample = self.depth_sample().collect()
                for r in sample:
                    if r.problem:
                        note("error", "depth_malformed", r.problem)
                shapes = {(r.height, r.width) for r in sample if not r.problem}
                if len(shapes) > 1:
                    note("error", "depth_shape_inconsistent", str(sorted(shapes)))
                elif shapes and shapes != {self.shape}:
                    note("error", "depth_shape_mismatch", f"{shapes.pop()}, not {self.shape}")
        if not exists(self.path("confidence_dir")):
            note("error", "confidence_dir_missing", self.path("confidence_dir"))
        elif (n := files.listing(self.spark, self.path("confidence_dir")).where("frame is not null").count()) != n_depth:
            note("warning", "confidence_count_mismatch", f"{n}, depth {n_depth}")
        if not exists(self.path("rgb")):
            note("error", "rgb_missing", self.path("rgb"))
        else:
            try:
                video, wanted = files.video_metadata(self.path("rgb")), self.config.get("dataset", {}).get("rgb")
                if wanted and (video["width"], video["height"]) != (wanted["width"], wanted["height"]):
                    note("warning", "rgb_resolution_mismatch", f"{video['width']} x {video['height']}")
            except (files.FormatError, KeyError, ValueError) as e:
                note("error", "rgb_unreadable", str(e))

    def _tables(self, note) -> None:
        poses = None
        if not exists(self.path("odometry")):
            note("error", "odometry_missing", self.path("odometry"))
        else:
            try:
                q = odometry_quality(self.spark, self.path("odometry")).first()
                poses = self.odometry()
                if q["malformed"]:
                    note("error", "odometry_malformed_rows", str(q["malformed"]))
                if q["duplicate_frames"]:
                    note("error", "odometry_duplicate_ids", str(q["duplicate_frames"][:10]))
                if q["missing_frames"]:
                    note("error", "odometry_missing_ids", str(q["missing_frames"][:10]))
                if clean.steps(in_file_order(poses), ["all"], ["row"], "timestamp").where("not monotonic").count():
                    note("error", "odometry_timestamps", "times don't rise")
            except ValueError as e:
                note("error", "odometry_invalid", str(e))
        tolerance = self.config.get("inventory", {})
        if not exists(self.path("camera_matrix")):
            note("error", "camera_matrix_missing", self.path("camera_matrix"))
        else:
            try:
                m = camera_matrix(self.spark, self.path("camera_matrix"))
                fixed = {"fx": m[0][0], "fy": m[1][1], "cx": m[0][2], "cy": m[1][2]}
                seen = poses.agg(*[f(k).alias(f"{n}_{k}") for k in fixed for n, f in (("lo", F.min), ("hi", F.max))]).first() if poses is not None else None
                for k, x in fixed.items():
                    if seen and seen[f"lo_{k}"] is not None and not seen[f"lo_{k}"] <= x <= seen[f"hi_{k}"]:
                        note("warning", "intrinsics_disagree", f"{k} {x} isn't in {seen[f'lo_{k}']} to {seen[f'hi_{k}']}")
            except (ValueError, TypeError) as e:
                note("error", "camera_matrix_invalid", str(e))
        if poses is not None and (s := clean.spread(poses, "fx", []).first()) and s["middle"]:
            if (s["largest"] - s["least"]) / s["middle"] > tolerance.get("intrinsics_variation_note_frac", 0.02):
                note("info", "intrinsics_vary", f"fx from {s['least']} to {s['largest']}")
        if not exists(self.path("imu")):
            note("error", "imu_missing", self.path("imu"))
        else:
            try:
                self.imu()
            except ValueError as e:
                note("error", "imu_invalid", str(e))

    def synchronization(self) -> DataFrame:
        """Check, ok and detail for each comparison of the streams; counts and ends of each stream are all it reads."""
        limits = {"duration_tolerance_frac": 0.01, "fps_tolerance_frac": 0.02} | self.config.get("synchronization", {})
        video = files.video_metadata(self.path("rgb"))
        d = files.listing(self.spark, self.path("depth_dir")).where("frame is not null").agg(F.count("*").alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
        poses = self.odometry()
        o = poses.agg(F.count("*").alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi"), (F.max("timestamp") - F.min("timestamp")).alias("span")).first()
        s = clean.steps(in_file_order(poses), ["all"], ["row"], "timestamp").first()
        n, fps, span = video["frame_count"], video["fps"], o["span"] or 0.0
        filmed = (n - 1) / fps if fps else 0.0
        rate = (o["n"] - 1) / span if span else 0.0
        checks = [
            ("streams_present", bool(n and d["n"] and o["n"]), f"rgb {n}, depth {d['n']}, odometry {o['n']}"),
            ("frame_counts_equal", n == d["n"] == o["n"], f"rgb {n}, depth {d['n']}, odometry {o['n']}"),
            ("depth_ids_match_odometry_frames", (d["lo"], d["hi"]) == (o["lo"], o["hi"]) and (d["hi"] is None or d["n"] == d["hi"] - d["lo"] + 1), f"{d['lo']} to {d['hi']}, {o['lo']} to {o['hi']}"),
            ("duration_agrees", span > 0 and abs(span - filmed) / span <= limits["duration_tolerance_frac"], f"{span:.6g} s, video {filmed:.6g} s"),
            ("effective_rate_matches_video_fps", fps > 0 and abs(rate - fps) / fps <= limits["fps_tolerance_frac"], f"{rate:.6g}, video {fps:.6g}"),
            ("timestamp_spacing_info", True, f"median {s['middle_step']}" if s else ""),
            ("timestamps_monotonic", bool(s and s["monotonic"]), ""),
        ]
        return self.spark.createDataFrame(checks, "check string, ok boolean, detail string")

    def fingerprint(self) -> dict:
        """SHA-256 of the tables' bytes and of the sorted names and sizes of the images; the video's size."""
        out = {}
        for name in ("odometry", "imu", "camera_matrix"):
            fs, inner = files.filesystem(self.path(name))
            with fs.open_input_stream(inner) as f:
                digest = hashlib.sha256()
                while part := f.read(1 << 20):
                    digest.update(part)
            out[name] = digest.hexdigest()
        for name in ("depth_dir", "confidence_dir"):
            fs, inner = files.filesystem(self.path(name))
            found = sorted(f"{i.base_name}:{i.size}" for i in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)))
            out[name] = hashlib.sha256("\n".join(found).encode()).hexdigest()
        fs, inner = files.filesystem(self.path("rgb"))
        return out | {"rgb": fs.get_file_info(inner).size}

    def provenance(self) -> dict:
        """The folder, its fingerprint, the configuration and its hash, the code's commit and the versions used."""

        def git(*what: str) -> str:
            return subprocess.run(["git", *what], cwd=os.path.dirname(__file__), capture_output=True, text=True, timeout=5).stdout.strip()

        try:
            commit = (git("rev-parse", "HEAD") or "unknown") + ("+dirty" if git("status", "--porcelain") else "")
        except (OSError, subprocess.SubprocessError):
            commit = "unknown"
        config = json.dumps(self.config, sort_keys=True, default=str)
        versions = {"python": platform.python_version(), "spark": self.spark.version, "numpy": np.__version__, "platform": platform.platform()}
        return {"input_path": self.folder, "fingerprint": self.fingerprint(), "config": self.config, "config_hash": hashlib.sha256(config.encode()).hexdigest(), "code_version": commit, "dependencies": versions}
