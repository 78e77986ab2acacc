"""Variables, methods, signs, units and presets of time aggregations, and what a request may combine."""

from __future__ import annotations

from dataclasses import dataclass

# Methods with (integrates over time, is a percentage, has a threshold).
METHODS = {
    "sum": (True, False, False),
    "max": (False, False, False),
    "max_time": (False, False, False),
    "min": (False, False, False),
    "mean": (False, False, False),
    "median": (False, False, False),
    "first": (False, False, False),
    "first_non_empty": (False, False, False),
    "last": (False, False, False),
    "last_non_empty": (False, False, False),
    "above_thres": (False, True, True),
    "below_thres": (False, True, True),
}

# Signs with their long names.
SIGNS = {"net": "Net", "pos": "Positive", "neg": "Negative", "abs": "Absolute", "": ""}


@dataclass(frozen=True)
class Variable:
    """Short name, kind (flow, node, or a hybrid of both), whether it takes a sign, its methods, units with multipliers, and the rule before resampling."""

    name: str
    kind: str
    signed: bool
    methods: tuple[str, ...]
    units: dict[str, tuple[float, float]]
    resample: str


ALL = tuple(METHODS)
NO_SUM = tuple(m for m in METHODS if m != "sum")

# The variables.
VARIABLES = [
    Variable("q", "flow", True, ALL, {"m3/s": (1, 1)}, "none"),
    Variable("u1", "flow", True, NO_SUM, {"m/s": (1, 1)}, "none"),
    Variable("au", "flow", False, NO_SUM, {"m2": (1, 1)}, "none"),
    Variable("qp", "flow", True, ALL, {"m3/s": (1, 1)}, "none"),
    Variable("up1", "flow", True, NO_SUM, {"m/s": (1, 1)}, "none"),
    Variable("ts_max", "flow", False, NO_SUM, {"s": (1, 1)}, "none"),
    Variable("grad", "flow_hybrid", True, NO_SUM, {"m": (1, 1)}, "none"),
    Variable("bed_grad", "flow_hybrid", False, (), {"m": (1, 1)}, "none"),
    Variable("wl_at_xsec", "flow_hybrid", False, NO_SUM, {"m": (1, 1)}, "none"),
    Variable("s1", "node", False, NO_SUM, {"m.a.s.l.": (1, 1)}, "none"),
    Variable("vol", "node", False, NO_SUM, {"m3": (1, 1)}, "split"),
    Variable("rain", "node", False, ALL, {"m3/s": (1, 1), "m3/h": (1, 3600)}, "split"),
    Variable("rain_depth", "node", False, ALL, {"mm/s": (1000, 1), "mm/h": (1000, 3600)}, "none"),
    Variable("infiltration_rate_simple", "node", False, ALL, {"m3/s": (1, 1), "m3/h": (1, 3600)}, "none"),
    Variable("infiltration_rate_simple_mm", "node", False, ALL, {"mm/s": (1000, 1), "mm/h": (1000, 3600)}, "none"),
    Variable("su", "node", False, NO_SUM, {"m2": (1, 1)}, "none"),
    Variable("uc", "node", False, NO_SUM, {"m/s": (1, 1)}, "none"),
    Variable("ucx", "node", True, NO_SUM, {"m/s": (1, 1)}, "none"),
    Variable("ucy", "node", True, NO_SUM, {"m/s": (1, 1)}, "none"),
    Variable("q_lat", "node", True, ALL, {"m3/s": (1, 1), "m3/h": (1, 3600)}, "split"),
    Variable("q_lat_mm", "node", True, ALL, {"mm/s": (1000, 1), "mm/h": (1000, 3600)}, "none"),
    Variable("intercepted_volume", "node", False, NO_SUM, {"m3": (1, 1)}, "split"),
    Variable("intercepted_volume_mm", "node", False, NO_SUM, {"mm": (1000, 1)}, "none"),
    Variable("q_sss", "node", True, ALL, {"m3/s": (1, 1), "m3/h": (1, 3600)}, "split"),
    Variable("q_sss_mm", "node", True, ALL, {"mm/s": (1000, 1), "mm/h": (1000, 3600)}, "none"),
    Variable("q_in_x", "node_hybrid", False, ALL, {"m3/s": (1, 1)}, "1d"),
    Variable("q_in_x_mm", "node_hybrid", False, ALL, {"mm/s": (1000, 1)}, "1d"),
    Variable("q_in_y", "node_hybrid", False, ALL, {"m3/s": (1, 1)}, "1d"),
    Variable("q_in_y_mm", "node_hybrid", False, ALL, {"mm/s": (1000, 1)}, "1d"),
    Variable("q_out_x", "node_hybrid", False, ALL, {"m3/s": (1, 1)}, "1d"),
    Variable("q_out_x_mm", "node_hybrid", False, ALL, {"mm/s": (1000, 1)}, "1d"),
    Variable("q_out_y", "node_hybrid", False, ALL, {"m3/s": (1, 1)}, "1d"),
    Variable("q_out_y_mm", "node_hybrid", False, ALL, {"mm/s": (1000, 1)}, "1d"),
]

BY_NAME = {v.name: v for v in VARIABLES}

# Kinds of flowlines whose flow doesn't limit the time step, those whose direction is turned, and of nodes.
NOT_REDUCING = [3, 4, 51, 52, 53, 54, 55, 56, 57, 58, 150, 200, 300, 400, 500]
TURNED = (51, 58)
NODE_TYPES = {1: "2D surface water", 2: "2D groundwater", 3: "1D without storage", 4: "1D with storage", 5: "2D surface water boundary", 6: "2D groundwater boundary", 7: "1D boundary"}
SENTINEL = -9999.0

# Presets as lists of (variable, sign, method, threshold).
PRESETS = {
    "no preset": [],
    "maximum water level": [("s1", None, "max", None)],
    "change in water level": [("s1", None, "first", None), ("s1", None, "last", None), ("s1", None, "min", None), ("s1", None, "max", None)],
    "flow pattern": [("q_out_x", None, "sum", None), ("q_out_y", None, "sum", None)],
    "time step reduction": [("ts_max", None, "below_thres", 1.0), ("ts_max", None, "below_thres", 3.0), ("ts_max", None, "below_thres", 5.0)],
    "source or sink (mm)": [("rain_depth", None, "sum", None), ("infiltration_rate_simple_mm", None, "sum", None), ("intercepted_volume_mm", None, "last", None)],
}


def of_kind(*kinds: str) -> list[str]:
    return [v.name for v in BY_NAME.values() if v.kind in kinds]


@dataclass(frozen=True)
class Request:
    """One aggregation: a variable, a sign if it is signed, a method, a threshold if the method has one, a unit."""

    variable: str
    method: str | None
    sign: str | None = None
    threshold: float | None = None
    unit: str | None = None

    def problems(self) -> list[str]:
        """Why the request can't be compiled; empty if it can."""
        v = BY_NAME.get(self.variable)
        if v is None:
            return [f"unknown variable {self.variable}"]
        found = []
        if self.sign not in (None, "") and (self.sign not in SIGNS or not v.signed):
            found.append(f"{v.name} takes no sign {self.sign}")
        if v.methods and self.method not in v.methods:
            found.append(f"{v.name} takes no method {self.method}")
        if not v.methods and self.method is not None:
            found.append(f"{v.name} takes no method")
        if self.method in METHODS and METHODS[self.method][2] != (self.threshold is not None):
            found.append(f"{self.method} and a threshold of {self.threshold} don't go together")
        if self.unit is not None and self.unit not in v.units:
            found.append(f"{v.name} has no unit {self.unit}")
        return found

    @property
    def column(self) -> str:
        """variable[_sign]_method[_threshold], in lower case, dots as underscores."""
        parts = [self.variable, self.sign or "", self.method or "", "" if self.threshold is None else str(float(self.threshold))]
        return "_".join(p for p in parts if p).replace(".", "_").lower()

    @property
    def multiplier(self) -> float:
        """Sums take a unit's first part only; percentages none; else both count."""
        v = BY_NAME[self.variable]
        first, second = v.units[self.unit or next(iter(v.units))]
        if self.method in METHODS and METHODS[self.method][1]:
            return 1.0
        return first if self.method == "sum" else first * second

    @property
    def unit_shown(self) -> str:
        unit = self.unit or next(iter(BY_NAME[self.variable].units))
        if self.method in METHODS and METHODS[self.method][1]:
            return "%"
        return unit.split("/")[0] if self.method == "sum" else unit


def preset(name: str) -> list[Request]:
    return [Request(v, m, s, t) for v, s, m, t in PRESETS[name]]
