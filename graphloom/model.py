"""The graph as DataFrames, and its edge grammar.

nodes(node_id, family, kind, label, status, state, maturity, grounding, attestation, content_hash)
edges(src, dst, relation, confidence, anchor, pending): a multigraph; `collapse_edges` keeps one edge of each (src, dst)
dangling(src, relation, target, anchor): edges whose target is not a node
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The tags that the ends of each relation may have.
SIGNATURES = {
    "contains": (["structure", "plan"], ["structure", "plan/task"]),
    "calls": (["structure/function", "structure/method", "structure/class"], ["structure/function", "structure/method", "structure/class", "structure/type"]),
    "imports": (["structure/file"], ["structure/file"]),
    "inherits": (["structure/class", "structure/type"], ["structure/class", "structure/type"]),
    "implements": (["plan/task"], ["structure"]),
    "tracks": (["plan/task"], ["intent"]),
    "requires": (["plan/task"], ["plan/task"]),
    "serves": (["memory"], ["intent", "plan/plan"]),
    "concerns": (["memory"], ["structure"]),
    "grounded_by": (["memory"], ["structure"]),
    "equivalent_to": (["memory"], ["memory"]),
    "supersedes": (["memory", "intent"], ["memory", "intent"]),
    "resolves": (["resolution"], ["memory", "intent"]),
    "disputes": (["memory", "intent"], ["memory", "intent"]),
    "depends_on": (["plan/task"], ["structure"]),
}
# The relation of a path of two relations; other pairs do not compose.
COMPOSE = {
    ("contains", "contains"): "contains",
    ("calls", "calls"): "calls",
    ("requires", "requires"): "requires",
    ("supersedes", "supersedes"): "supersedes",
    ("implements", "contains"): "implements",
    ("concerns", "contains"): "concerns",
    ("implements", "calls"): "depends_on",
    ("depends_on", "calls"): "depends_on",
    ("depends_on", "contains"): "depends_on",
}
# Confidences from weak to strong, provenance tiers from strong to weak.
CONFIDENCE = ["AMBIGUOUS", "INFERRED", "EXTRACTED"]
TIERS = ["human", "must", "empirical", "architectural", "plan-assumption", "structural", "llm"]
# Tags that an id's prefix implies.
PREFIX_TAGS = {
    "sym": ["structure"],
    "file": ["structure", "structure/file"],
    "module": ["structure", "structure/module"],
    "int": ["intent", "intent/intent"],
    "task": ["plan", "plan/task"],
    "plan": ["plan", "plan/plan"],
    "mem": ["memory"],
}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    dangling: DataFrame
