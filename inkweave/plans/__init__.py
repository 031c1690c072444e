"""Named queries over the given tables, one module for each family."""

ALL_MODULES: list[str] = [f"inkweave.plans.{m}" for m in ("relational", "texts", "retrieval", "graphs", "consistency", "chronicle", "operations", "narratives", "reports", "cases")]
