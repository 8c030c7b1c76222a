"""Registered queries do the whole job."""

from causeway import queries
from causeway.operators import impact, scenarios


def test_resilience_score_has_the_full_budget(spark, data, monkeypatch):
    seen = {}
    monkeypatch.setattr(impact, "analyze", lambda edges, nodes, budget=impact.BUDGET: seen.update(budget=budget))
    queries.resilience_score(spark, data)
    assert seen == {"budget": 400}


def test_hops_and_counts_have_every_source(spark, data):
    _, _, nodes = queries._network(spark, data, "supplier")
    every = {r["id"] for r in nodes.select("id").collect()}
    for query in (queries.sssp_hops, queries.sigma_counts):
        assert {r["s"] for r in query(spark, data).collect()} == every


def test_removal_impact_has_every_edge(spark, data):
    _, edges, _ = queries._network(spark, data, "supplier")
    every = {(r["u"], r["v"]) for r in edges.select("u", "v").collect()}
    assert len(every) > 5 and {(r["u"], r["v"]) for r in queries.removal_impact(spark, data).collect()} == every


def test_attacks_have_the_default_steps_and_both_areas(spark, data, monkeypatch):
    seen = []

    def curve(edges, nodes, steps=20, seed=7):
        seen.append(steps)
        return spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 0.5)], "step bigint, fraction double, lcc double")

    monkeypatch.setattr(scenarios, "random_attack", curve)
    monkeypatch.setattr(scenarios, "targeted_attack", curve)
    found = {r["strategy"]: r["auc"] for r in queries.robustness_auc(spark, data).collect()}
    assert found == {"random": 0.75, "targeted": 0.75} and seen == [20, 20]
