"""Schemas, domains and fixed weights of the typed memory graph."""

from __future__ import annotations

NODE_TYPES = ["status", "reason", "action", "thing", "person", "emotion"]
RELATIONS = ["causal", "scenario", "sequence", "preference", "social", "attribute", "temporal", "taxonomic"]
#: Relations that hold both ways: creating one creates its reverse.
MUTUAL = ["scenario", "social", "attribute"]
#: Relations that come first when edges are added to a path.
DIRECTIONAL = ["causal", "sequence", "preference", "temporal", "taxonomic"]

# Fixed values: (forward, reverse) weight of following a relation, in the order of RELATIONS, from a node of each type.
JUMP = {
    "status": [(0.9, 1.0), (0.8, 0.8), (0.7, 0.0), (0.4, 0.0), (0.5, 0.5), (0.3, 0.3), (0.3, 0.0), (0.0, 0.0)],
    "reason": [(1.0, 0.9), (0.6, 0.6), (0.8, 0.0), (0.2, 0.0), (0.4, 0.4), (0.3, 0.3), (0.3, 0.0), (0.0, 0.0)],
    "action": [(0.9, 0.7), (0.8, 0.8), (0.9, 0.6), (0.5, 0.0), (0.6, 0.6), (0.4, 0.4), (0.5, 0.0), (0.0, 0.3)],
    "thing": [(0.3, 0.3), (1.0, 1.0), (0.4, 0.4), (0.8, 0.0), (0.3, 0.3), (0.7, 0.7), (0.3, 0.0), (0.0, 0.3)],
    "person": [(0.5, 0.5), (0.6, 0.6), (0.5, 0.5), (0.8, 0.0), (1.0, 1.0), (0.7, 0.7), (0.4, 0.0), (0.0, 0.0)],
    "emotion": [(0.9, 1.0), (0.8, 0.8), (0.6, 0.0), (0.5, 0.0), (0.5, 0.5), (0.4, 0.4), (0.3, 0.0), (0.0, 0.0)],
}

# Preferences of the three purpose frames, and the cue words that choose one, in order of precedence.
FRAME_TYPES = {
    "vent": {"emotion": 1.0, "status": 0.55, "reason": 0.35, "action": 0.15, "thing": 0.05, "person": 0.05},
    "plan": {"action": 1.0, "thing": 0.45, "status": 0.25, "reason": 0.20, "emotion": 0.05, "person": 0.05},
    "recommend": {"action": 1.0, "thing": 0.55, "status": 0.35, "person": 0.25, "emotion": 0.05, "reason": 0.10},
}
FRAME_RELATIONS = {
    "vent": {"causal": 1.0, "attribute": 0.7, "social": 0.3, "scenario": 0.2},
    "plan": {"sequence": 1.0, "temporal": 0.8, "scenario": 0.4, "causal": 0.3},
    "recommend": {"taxonomic": 1.0, "attribute": 0.8, "preference": 0.5, "scenario": 0.3},
}
FRAME_CUES = {
    "vent": "倾诉|表达|寻求|共情|理解|安慰|鼓励|共鸣|怀念|担心|难受|不满|焦虑|感慨",
    "plan": "规划|安排|梳理|列出|设定|设置|确定|准备|标出|预留|步骤|节奏|拆分|进度",
    "recommend": "推荐|比较|获取|建议|选择|方向|选项",
}
TYPE_FLOOR, RELATION_FLOOR = 0.25, 0.15


def jump_rows() -> list[tuple[str, str, bool, float]]:
    """The weights as (node_type, rel_type, is_reverse, weight), 96 rows."""
    return [(t, r, rev, w[rev]) for t, ws in JUMP.items() for r, w in zip(RELATIONS, ws, strict=True) for rev in (False, True)]
