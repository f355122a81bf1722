"""Retrieval settings as a file: defaults, ranges, and a full fall back to the defaults where a file is broken."""

from __future__ import annotations

import json

from tessera.operators.par import Params
from tessera.schema import JUMP, RELATIONS

#: Group, name, least and largest value, default; a whole-number default makes a whole-number setting.
SETTINGS = [
    ("retrieval", "seed_k", 1, 50, 5),
    ("retrieval", "max_hops", 1, 10, 5),
    ("retrieval", "expand_k", 0, 50, 0),
    ("retrieval", "max_peak_nodes", 0, 2000, 0),
    ("retrieval", "seed_cos_min", 0, 1, 0.0),
    ("retrieval", "temporal_k_seed", 1, 30, 8),
    ("retrieval", "temporal_max_facts", 0, 50, 8),
    ("retrieval", "temporal_max_anchors", 1, 10, 3),
    ("scoring", "distance_decay", 0, 1, 0.85),
    ("scoring", "jump_weight_coef", 0, 1, 0.5),
    ("scoring", "purpose_weight_coef", 0, 1, 0.5),
    ("scoring", "purpose_filter_threshold", 0, 1, 0.30),
    ("scoring", "purpose_filter_decay", 0, 1, 0.0),
    ("scoring", "peak_tolerance", 0, 1, 0.10),
    ("scoring", "peak_tolerance_ratio", 0, 1, 0.0),
]


def defaults() -> dict:
    """All settings at their defaults; weights hold (forward, reverse) by node type and relation."""
    out: dict = {"retrieval": {}, "scoring": {}}
    for group, name, _, _, value in SETTINGS:
        out[group][name] = value
    out["weights"] = {t: {r: list(w) for r, w in zip(RELATIONS, ws, strict=True)} for t, ws in JUMP.items()}
    return out


def _number(value: object, whole: bool, least: float, most: float, name: str) -> float | int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or (whole and value != int(value)) or not least <= value <= most:
        raise ValueError(f"{name}: {'a whole number' if whole else 'a number'} from {least} to {most}, not {value!r}")
    return int(value) if whole else float(value)


def checked(given: dict) -> dict:
    """The defaults with the given settings; ValueError for unknown ones and values out of range."""
    out, known = defaults(), {(g, n): (least, most, isinstance(value, int)) for g, n, least, most, value in SETTINGS}
    for group, values in (given or {}).items():
        if group not in out or not isinstance(values, dict):
            raise ValueError(f"no such group: {group}")
        for name, value in values.items():
            if group == "weights":
                if name not in JUMP or not isinstance(value, dict) or not set(value) <= set(RELATIONS):
                    raise ValueError(f"no such weights: {name}")
                for relation, pair in value.items():
                    if not isinstance(pair, (list, tuple)) or len(pair) != 2:
                        raise ValueError(f"{name}.{relation}: two weights")
                    out["weights"][name][relation] = [_number(w, False, 0, 1, f"{name}.{relation}") for w in pair]
            elif (group, name) not in known:
                raise ValueError(f"no such setting: {group}.{name}")
            else:
                least, most, whole = known[group, name]
                out[group][name] = _number(value, whole, least, most, name)
    return out


def read(text: str | None) -> dict:
    """Settings from the JSON text of a file; the defaults, all of them, where there is none or anything in it is wrong."""
    try:
        return checked(json.loads(text or "{}"))
    except (ValueError, AttributeError):
        return defaults()


def retrieval(settings: dict) -> tuple[Params, list[tuple]]:
    """Params and step weights (as retrieve() takes them) of settings; zeros that stand for no limit become none."""
    r, s = settings["retrieval"], settings["scoring"]
    p = Params(
        seed_k=r["seed_k"],
        max_hops=r["max_hops"],
        expand_k=r["expand_k"] or None,
        max_nodes=r["max_peak_nodes"] or None,
        seed_floor=r["seed_cos_min"] or None,
        decay=s["distance_decay"],
        jump_coef=s["jump_weight_coef"],
        purpose_coef=s["purpose_weight_coef"],
        threshold=s["purpose_filter_threshold"],
        threshold_decay=s["purpose_filter_decay"],
        tolerance=s["peak_tolerance"],
        tolerance_ratio=s["peak_tolerance_ratio"],
    )
    return p, [(t, rel, rev, w[rev]) for t, ws in settings["weights"].items() for rel, w in ws.items() for rev in (False, True)]
