"""donorlens: donor-income analytics as Spark DataFrame plans."""

__all__ = ["catalog", "functions", "operators", "params", "plans", "sources"]
