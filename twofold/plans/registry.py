"""Projections, community algorithms, centralities and stages by name; a name is taken once."""

from __future__ import annotations

from collections.abc import Callable

from twofold.errors import ContractError
from twofold.operators import centrality, communities, projection


class Registry(dict):
    def add(self, name: str, function: Callable) -> Callable:
        if name in self:
            raise ContractError(f"{name!r} is taken")
        self[name] = function
        return function

    def get_or_fail(self, name: str) -> Callable:
        if name not in self:
            raise ContractError(f"unknown {name!r}; one of {sorted(self)}")
        return self[name]


def check_options(given: dict, allowed: set[str], what: str) -> None:
    odd = sorted(set(given) - allowed)
    if odd:
        raise ContractError(f"{what} doesn't take {odd}; it takes {sorted(allowed)}")


PROJECTIONS, COMMUNITIES, CENTRALITIES, STAGES = Registry(), Registry(), Registry(), Registry()
for _name in projection.CONTRIBUTIONS:
    PROJECTIONS.add(_name, lambda graph, side, min_weight=None, _w=_name: projection.project(graph, side, _w, min_weight))
for _name in communities.ALGORITHMS:
    COMMUNITIES.add(_name, lambda nodes, edges, _a=_name, **o: communities.partition(nodes, edges, _a, **o))
CENTRALITIES.add("degree", centrality.degree)
CENTRALITIES.add("strength", centrality.strength)
CENTRALITIES.add("betweenness", centrality.betweenness)
CENTRALITIES.add("eigenvector", lambda nodes, edges, **o: centrality.eigenvector(nodes, edges, **o)[0])
