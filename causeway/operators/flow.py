"""Largest flows and smallest cuts between zones, many pairs of zones at a time."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = "od string, max_flow double, u bigint, v bigint, capacity double"


def _augment(edges: list[tuple[int, int, float, float]], sources: set[int], sinks: set[int]) -> tuple[float, set[int]]:
    """Flow by shortest augmenting paths, and what the sources still reach."""
    room: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for u, v, there, back in edges:
        room[u][v] += there
        room[v][u] += back
    total = 0.0
    while True:
        came = dict.fromkeys(sources)
        queue, end = deque(sorted(sources)), None
        while queue and end is None:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    if v in sinks:
                        end = v
                        break
                    queue.append(v)
        if end is None:
            return total, set(came)
        steps, v = [], end
        while came[v] is not None:
            steps.append((came[v], v))
            v = came[v]
        least = min(room[a][b] for a, b in steps)
        for a, b in steps:
            room[a][b] -= least
            room[b][a] += least
        total += least


def min_cuts(edges: DataFrame, zones: DataFrame, directed: bool = False) -> DataFrame:
    """``(od, max_flow, u, v, capacity)``: the cut nearest the sources for each pair of zones.

    ``edges`` is (u, v, capacity), ``zones`` (od, id, role) with role ``source`` or ``sink``; ids in both are sinks.  A
    pair with an empty zone, or no cut, has one row with null u, v and its flow (0 for an empty zone).  Each pair is one
    group with the whole network, so the network must fit a task; pairs run beside each other.
    """
    pairs = zones.select("od").distinct()
    roads = pairs.crossJoin(edges.select("u", "v", F.col("capacity").cast("double").alias("capacity"))).select("od", "u", "v", "capacity", F.lit("road").alias("role"))
    rows = roads.unionByName(zones.select("od", F.col("id").alias("u"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("double").alias("capacity"), "role"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        od, road = part["od"].iloc[0], part[part["role"] == "road"]
        known = set(road["u"]) | set(road["v"])
        sinks = {int(x) for x in part.loc[part["role"] == "sink", "u"]} & known
        sources = ({int(x) for x in part.loc[part["role"] == "source", "u"]} & known) - sinks
        listed = [(int(u), int(v), float(c), 0.0 if directed else float(c)) for u, v, c in zip(road["u"], road["v"], road["capacity"], strict=True)]
        flow, near = _augment(listed, sources, sinks) if sources and sinks else (0.0, set())
        cut = [(od, flow, u, v, c) for u, v, c, _ in listed if (u in near) != (v in near) and (not directed or u in near)]
        return pd.DataFrame(cut or [(od, flow, None, None, None)], columns=["od", "max_flow", "u", "v", "capacity"]).astype({"u": "Int64", "v": "Int64"})

    return rows.groupBy("od").applyInPandas(solve, CUT)
