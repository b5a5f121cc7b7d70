import sys

from auditloom.plans import catalogue
from auditloom.sources import work


def test_registry_findings_are_no_single_plan_of_all_detectors(spark, sf):
    plan = catalogue.registry_findings(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_registry_findings_are_made_in_small_steps(spark, sf, monkeypatch):
    """The driver's memory goes with the plans it has to make: each step's operators, and how often the table of dependencies is read by all of them."""
    stage, plans = work.stage_table, []

    def noted(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, *a)

    for m in [m for n, m in sys.modules.items() if n.startswith("auditloom.") and getattr(m, "stage_table", None) is stage]:
        monkeypatch.setattr(m, "stage_table", noted)
    catalogue.registry_findings(spark, sf)
    assert max(p.count("\n") for p in plans) < 100
    assert sum(p.count("package_properties.parquet") for p in plans) <= 10
