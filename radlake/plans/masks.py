"""Mask pipelines: an ordered list of operations on named masks, from JSON or text."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import lines as L
from ..operators import voxels as V
from ..registry import OPERATIONS

#: Parameters of each operation and their defaults (fixed values); n, gaussian_smooth and convex_hull are ours.
PARAMETERS: dict[str, dict[str, object]] = {
    "expand": {"margin_mm": 5.0, "kernel_type": "ball"},
    "contract": {"margin_mm": 3.0, "kernel_type": "ball"},
    "margin": {"margin_mm": 0.0, "kernel_type": "ball"},
    "anisotropic_margin": {"margin_x_mm": 0.0, "margin_y_mm": 0.0, "margin_z_mm": 0.0},
    "union": {"other_roi": None},
    "intersection": {"other_roi": None},
    "subtract": {"other_roi": None, "margin_mm": 0.0},
    "crop_to_boundary": {"boundary_roi": None},
    "smooth": {"smoothing_mm": 1.0, "iterations": 1},
    "fill_holes": {"fully_connected": False},
    "remove_small_components": {"min_size_mm3": 100.0},
    "keep_largest": {"n": 1},
    "close_gaps": {"gap_size_mm": 2.0},
    "remove_protrusions": {"protrusion_size_mm": 2.0},
    "convex_hull": {},
    "gaussian_smooth": {"sigma_mm": 1.0, "threshold": 0.5},
}
#: The same when a stored definition with structures is executed (fixed values).
EXECUTED: dict[str, dict[str, object]] = {
    "expand": {"margin_mm": 5.0, "kernel_type": "ball"},
    "contract": {"margin_mm": 3.0, "kernel_type": "ball"},
    "union": {},
    "intersection": {},
    "subtract": {"margin_mm": 0.0},
    "crop_to_boundary": {},
    "smooth": {"smoothing_mm": 2.0, "iterations": 1},
    "fill_holes": {},
    "remove_small_components": {"min_size_mm3": 100.0},
    "keep_largest": {},
}
#: Structures that an executed step names: fewest, most.
NAMED = {"expand": (1, 1), "contract": (1, 1), "crop_to_boundary": (1, 1), "union": (2, None), "intersection": (2, None), "subtract": (2, None)}
KERNELS = ("ball", "box", "cross")


def parse_text(text: str) -> list[dict]:
    """``op(k=v, ...) | op``: numbers and words are told apart."""
    out = []
    for step in filter(None, (s.strip() for s in text.split("|"))):
        name, arguments = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", step).groups()
        parameters = {}
        for pair in filter(None, (p.strip() for p in (arguments or "").split(","))):
            key, value = (x.strip() for x in pair.split("=", 1))
            for kind in (int, float, str):
                try:
                    parameters[key] = kind(value.strip("\"'") if kind is str else value)
                    break
                except ValueError:
                    pass
        out.append({"type": name, "parameters": parameters})
    return out


def parse_json(text: str) -> list[dict]:
    return json.loads(text)["operations"]


def to_json(operations: list[dict]) -> str:
    """What parse_json reads."""
    return json.dumps({"operations": operations})


def to_text(operations: list[dict]) -> str:
    """What parse_text reads; structures and names of results have no place in it."""
    shown = lambda p: ", ".join(f"{k}={v}" for k, v in p.items())
    return " | ".join(f"{o['type']}({shown(o.get('parameters', {}))})" if o.get("parameters") else o["type"] for o in operations)


Size = tuple[int, int, int]
Spacing = tuple[float, float, float]


def _margin(rows: DataFrame, millimetres: float, size: Size, spacing: Spacing, shape: object = "ball") -> DataFrame:
    """A margin as line rows; an unknown shape is a ball."""
    if not millimetres:
        return rows
    shape = str(shape).lower()
    return L.morph(rows, [(millimetres > 0, V.ball(millimetres, spacing, shape if shape in KERNELS else "ball"), True)], size)


def _refined(kind: str, rows: DataFrame, p: dict, size: Size, spacing: Spacing) -> DataFrame:
    """Steps on one mask."""
    if kind in ("expand", "margin", "contract"):
        return _margin(rows, float(p["margin_mm"]) * (-1 if kind == "contract" else 1), size, spacing, p["kernel_type"])
    if kind == "anisotropic_margin":
        return L.morph(rows, V.directed_steps(tuple(float(p[f"margin_{a}_mm"]) for a in "xyz"), spacing), size)
    if kind == "smooth":
        element = V.ball(float(p["smoothing_mm"]), spacing)
        for _ in range(int(p["iterations"])):
            rows = L.morph(rows, L.closing(element) + L.opening(element), size)
        return rows
    if kind == "close_gaps":
        return L.morph(rows, L.closing(V.ball(float(p["gap_size_mm"]), spacing)), size)
    if kind == "remove_protrusions":
        return L.morph(rows, L.opening(V.ball(float(p["protrusion_size_mm"]), spacing)), size)
    if kind == "fill_holes":
        return K.filled_parts(rows, size, bool(p.get("fully_connected", False)))
    if kind == "remove_small_components":
        return K.without_small_parts(rows, float(p["min_size_mm3"]), spacing[0] * spacing[1] * spacing[2])
    if kind == "keep_largest":
        return K.largest_parts(rows, int(p.get("n", 1)))
    if kind == "gaussian_smooth":
        return L.lines(K.apply_mask(L.voxels(rows), size, lambda m: K.gaussian(m, float(p["sigma_mm"]), float(p["threshold"]), spacing)))
    return rows  # convex_hull: the studied application returns the mask as it is


def _combined(kind: str, rows: DataFrame, others: list[DataFrame]) -> DataFrame:
    how = {"union": "union", "intersection": "intersection", "subtract": "subtraction", "crop_to_boundary": "intersection"}[kind]
    for other in others:
        rows = L.joined(rows, other, how)
    return rows


def _threaded(number: int, step: dict, current: DataFrame | None, rois: dict[str, DataFrame], size: Size, spacing: Spacing) -> DataFrame:
    """One step of a pipeline that hands one mask on; rois: line rows by name."""
    kind, p = step["type"], PARAMETERS[step["type"]] | step.get("parameters", {})
    names = list(step.get("structures") or [])
    if step.get("source_roi"):
        current = _roi(number, step["source_roi"], rois)
    elif current is None:
        if not names:
            raise ValueError(f"step {number}: nothing to work on")
        current, names = _roi(number, names[0], rois), names[1:]
    if kind not in ("union", "intersection", "subtract", "crop_to_boundary"):
        return _refined(kind, current, p, size, spacing)
    names += [p[n] for n in ("other_roi", "boundary_roi") if p.get(n)]
    if not names:
        raise ValueError(f"step {number}: {kind} needs another mask")
    others = [_roi(number, n, rois) for n in names]
    if kind == "subtract" and float(p["margin_mm"]):
        others = [_margin(o, float(p["margin_mm"]), size, spacing) for o in others]
    return _combined(kind, current, others)


def _executed(number: int, step: dict, current: DataFrame | None, rois: dict[str, DataFrame], size: Size, spacing: Spacing) -> DataFrame:
    """One step of a stored definition: steps that name structures start from these, the others go on with the result so far."""
    kind, p = step["type"], EXECUTED[step["type"]] | step.get("parameters", {})
    masks = [_roi(number, n, rois) for n in step.get("structures") or []]
    least, most = NAMED.get(kind, (0, None))
    if len(masks) < least or most is not None and len(masks) > most:
        raise ValueError(f"step {number}: {kind} takes {least}{'' if most else ' or more'} structures")
    if kind not in NAMED or kind == "crop_to_boundary":
        if current is None:
            raise ValueError(f"step {number}: {kind} needs a result")
        return _combined(kind, current, masks) if kind == "crop_to_boundary" else _refined(kind, current, p, size, spacing)
    if kind in ("expand", "contract"):
        return _refined(kind, masks[0], p, size, spacing)
    out = _combined(kind, masks[0], masks[1:])
    return _margin(out, float(p["margin_mm"]), size, spacing) if kind == "subtract" and float(p["margin_mm"]) > 0 else out


def _roi(number: int, name: str, rois: dict[str, DataFrame]) -> DataFrame:
    if name not in rois:
        raise ValueError(f"step {number}: no mask {name}")
    return rois[name]


def run(operations: list[dict], masks: dict[str, DataFrame], size: Size, spacing: Spacing = (1.0, 1.0, 1.0), dialect: str = "pipeline", start: DataFrame | None = None) -> DataFrame:
    """Applies the operations in order; each step is a DataFrame of line rows, nothing runs here.

    masks: voxel rows by name; axes i, j, k are x, y, z. dialect pipeline: one
    mask is handed on from ``start``, or from the first of ``structures`` of the
    first step; ``source_roi`` puts another one in its place, ``output_name`` keeps
    a result under a name, ``other_roi`` and ``boundary_roi`` (and further
    ``structures``) are the other operands; ``margin_mm`` of subtract widens them.
    dialect executor: a step with ``structures`` works on these alone and replaces
    the result so far (so an earlier one is lost), the others go on with it;
    ``margin_mm`` of subtract widens the result.

    A name that is missing, an operation or a parameter that is unknown, or too
    few operands raise with the number of the step. Registered operations come
    before the built-in ones and take voxel rows.
    """
    known, step_of = (EXECUTED, _executed) if dialect == "executor" else (PARAMETERS, _threaded)
    rois = {name: L.lines(m) for name, m in masks.items()}
    current = L.lines(start) if start is not None else None
    for number, step in enumerate(operations, 1):
        kind = step["type"]
        if kind in OPERATIONS:
            own = [_roi(number, n, rois) for n in ([step["source_roi"]] if step.get("source_roi") else []) + list(step.get("structures") or [])]
            inputs = own if current is None or step.get("source_roi") else [current, *own]
            if not inputs:
                raise ValueError(f"step {number}: nothing to work on")
            voxels = [L.voxels(m) for m in inputs]
            current = L.lines(OPERATIONS[kind](voxels[0], voxels[1:], dict(step.get("parameters", {})), size, spacing))
        else:
            if kind not in known:
                raise ValueError(f"step {number}: no operation {kind}")
            unknown = set(step.get("parameters", {})) - set(known[kind])
            if unknown:
                raise ValueError(f"step {number}: {kind} has no parameter {', '.join(sorted(unknown))}")
            current = step_of(number, step, current, rois, size, spacing)
        if step.get("output_name"):
            rois = rois | {step["output_name"]: current}
    if current is None:
        raise ValueError("no operations")
    return L.voxels(current)


def describe(operations: DataFrame) -> DataFrame:
    """Pipelines stored as JSON text in ``definition``: one row per step."""
    schema = "operations array<struct<type:string,structures:array<string>,parameters:map<string,string>>>"
    parsed = operations.withColumn("_p", F.from_json("definition", schema))
    return parsed.select("*", F.posexplode("_p.operations").alias("step", "operation")).drop("_p")
