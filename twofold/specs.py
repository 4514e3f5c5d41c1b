"""Specifications of graphs, projections and runs."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from twofold.errors import ContractError

# The closed vocabularies of the data model.
GRANULARITIES = ("module", "module_presentation", "assessment", "vle_site", "vle_activity_type")
CRITERIA = ("score_threshold", "final_result_pass", "vle_activity")
RESULTS = ("Pass", "Distinction", "Fail", "Withdrawn")
PASSED = ("Pass", "Distinction")
NOT_PASSED = ("Fail", "Withdrawn")
SIDES = ("student", "discipline")
WEIGHTINGS = ("simple", "resource_allocation")
# Pairs that can't be built, with the reason.
IMPOSSIBLE = {
    ("vle_site", "score_threshold"): "clicks on a site have no score",
    ("vle_activity_type", "score_threshold"): "clicks on an activity have no score",
    ("assessment", "vle_activity"): "assessments have no clicks",
}


@dataclass(frozen=True)
class BipartiteSpec:
    dataset: str
    granularity: str = "module_presentation"
    edge_criterion: str = "score_threshold"
    threshold: float | None = None
    cohort: str | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        if self.granularity not in GRANULARITIES:
            raise ContractError(f"unknown granularity {self.granularity!r}; one of {GRANULARITIES}")
        if self.edge_criterion not in CRITERIA:
            raise ContractError(f"unknown edge criterion {self.edge_criterion!r}; one of {CRITERIA}")
        reason = IMPOSSIBLE.get((self.granularity, self.edge_criterion))
        if reason:
            raise ContractError(f"{self.granularity} with {self.edge_criterion}: {reason}")


@dataclass(frozen=True)
class ProjectionSpec:
    side: str
    weighting: str = "simple"
    min_weight: float | None = None

    def __post_init__(self) -> None:
        if self.side not in SIDES or self.weighting not in WEIGHTINGS:
            raise ContractError(f"unknown projection {self.side!r}, {self.weighting!r}")
        if self.min_weight is not None and self.min_weight <= 0:
            raise ContractError(f"min_weight must be positive, not {self.min_weight}")

    @property
    def projection_id(self) -> str:
        return f"{self.side}_{self.weighting}"


@dataclass(frozen=True)
class RunConfig:
    source: dict
    bipartite: BipartiteSpec
    projections: tuple[ProjectionSpec, ...] = ()
    community: dict = field(default_factory=dict)
    centrality: dict = field(default_factory=dict)
    stages: tuple[str, ...] = ("data", "community", "centrality")


def load_config(path: str | Path) -> RunConfig:
    """A run from a TOML file."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    try:
        return RunConfig(
            source=raw["source"],
            bipartite=BipartiteSpec(**raw["bipartite"]),
            projections=tuple(ProjectionSpec(**p) for p in raw.get("projections", [])),
            community=raw.get("community", {}),
            centrality=raw.get("centrality", {}),
            stages=tuple(raw.get("stages", RunConfig.stages)),
        )
    except (KeyError, TypeError) as error:
        raise ContractError(f"{path}: {error}") from error
