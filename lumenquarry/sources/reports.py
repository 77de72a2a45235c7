"""Small files of one scene (S9, S10, S12, K2 to K5, K7 to K9): ground truth, scenes, calibrations, reports and plans."""

from __future__ import annotations

import json
import math
import time
import warnings
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators.measure import walk


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Kind, place, value: a row for each value of the quantities that the file has; others are absent."""
    rows = []
    for kind, value in (yaml.safe_load(Path(path).read_text()) or {}).items():
        rows += [(kind, k, float(v)) for k, v in enumerate(value if isinstance(value, list) else [value])]
    return spark.createDataFrame(rows, "kind string, place int, value double")


def measurements_of(spark: SparkSession, path: str) -> DataFrame:
    """Path, value, unit, status, method, lower, upper of every measurement of a scene file."""
    rows = []
    for at, m in walk(json.loads(Path(path).read_text())):
        ci = m.get("confidence_interval") or {}
        rows.append((at, m["value"], m["unit"], m["status"], m["method"], ci.get("lower"), ci.get("upper")))
    return spark.createDataFrame(rows, "path string, value double, unit string, status string, method string, lower double, upper double")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Tier, kind, quantile, n of a calibration file."""
    rows = [(t, k, float(x["quantile"]), int(x["n"])) for t, kinds in json.loads(Path(path).read_text()).items() for k, x in kinds.items()]
    return spark.createDataFrame(rows, "tier string, kind string, quantile double, n long")


def calibration_report(table: DataFrame) -> dict:
    """K5: the calibration (tier, kind, quantile, n: a row for each tier and kind) as a file's tree."""
    out: dict = {}
    for r in table.collect():
        out.setdefault(r.tier, {})[r.kind] = {"quantile": r.quantile, "n": r.n}
    return out


def saved(path: str, write: Callable[[Path], None]) -> str:
    """K9: writes a file; where that fails, a sibling with the time in its name, with a warning. Gives the file's name."""
    at = Path(path)
    try:
        write(at)
    except OSError as e:
        at = at.with_name(f"{at.stem}_{time.strftime('%Y%m%d_%H%M%S')}{at.suffix}")
        warnings.warn(f"{path} can't be written ({e}); {at} is", stacklevel=2)
        write(at)
    return str(at)


def write_report(report: dict, path: str) -> str:
    """K2 to K5: a report as JSON; keys that begin with a low line are private and left out."""

    def public(x):
        if isinstance(x, dict):
            return {k: public(v) for k, v in x.items() if not str(k).startswith("_")}
        return [public(v) for v in x] if isinstance(x, (list, tuple)) else x

    text = json.dumps(public(report), indent=2, default=lambda x: x.item() if hasattr(x, "item") else str(x))
    return saved(path, lambda at: at.write_text(text))


def plan_svg(walls: DataFrame, path: str, unreliable: bool = False, scale: float = 100.0) -> str:
    """K7: a plan of one scene's walls (columns of operators.walls) with their lengths; a dashed red one with a banner where
    the area is unreliable."""
    lines, ends = [], []
    for w in walls.collect():
        a, b = ((w.cx + s * w.tx, w.cy + s * w.ty) for s in (w.s_min, w.s_max))
        ends += [a, b]
        lines.append((a, b, f"{w.s_max - w.s_min:.2f} m"))
    return drawn(path, ends, lines, [], unreliable, scale)


def cells_svg(cells: DataFrame, path: str, size: float, most: int = 60000) -> str:
    """K8: cells (i, j, and label where there is one) seen from above, at most `most` of them by a hash: a debug picture."""
    from pyspark.sql import functions as F

    n = cells.count()
    part = max(1, math.ceil(n / most))
    rows = cells.where(F.pmod(F.xxhash64("i", "j"), F.lit(part)) == 0).limit(most).collect()
    dots = [((r.i + 0.5) * size, (r.j + 0.5) * size, hash(r.label) % 360 if "label" in cells.columns else 0) for r in rows]
    return drawn(path, [d[:2] for d in dots], [], dots, False, 100.0)


def drawn(path: str, ends: list, lines: list, dots: list, unreliable: bool, scale: float) -> str:
    lo = [min((p[k] for p in ends), default=0.0) - 0.5 for k in (0, 1)]
    hi = [max((p[k] for p in ends), default=0.0) + 0.5 for k in (0, 1)]
    at = lambda p: ((p[0] - lo[0]) * scale, (hi[1] - p[1]) * scale)
    style = 'stroke="red" stroke-dasharray="8 6"' if unreliable else 'stroke="black"'
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{(hi[0] - lo[0]) * scale:.0f}" height="{(hi[1] - lo[1]) * scale:.0f}">']
    for a, b, said in lines:
        (x1, y1), (x2, y2) = at(a), at(b)
        out.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" {style}/><text x="{(x1 + x2) / 2:.1f}" y="{(y1 + y2) / 2:.1f}">{escape(said)}</text>')
    for x, y, hue in dots:
        px, py = at((x, y))
        out.append(f'<circle cx="{px:.1f}" cy="{py:.1f}" r="1" fill="hsl({hue},60%,40%)"/>')
    if unreliable:
        out.append('<text x="10" y="20" fill="red">area unreliable</text>')
    text = "\n".join([*out, "</svg>"])
    return saved(path, lambda f: f.write_text(text))
