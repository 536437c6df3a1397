"""Metrics of executed plans."""


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    elif name == "ReusedExchangeExec":
        return
    else:
        yield plan
        children = plan.children()
        for k in range(children.size()):
            yield from _nodes(children.apply(k))


def scans(df, table):
    """Rows given by every scan of a folder or table with this name, after ``df.collect()``."""
    out = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec" and table in node.toString():
            out.append(node.metrics().apply("numOutputRows").value())
    return out


def sent(df, column):
    """Rows of every table with this column that is sent to all tasks, after ``df.collect()``."""
    out = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "BroadcastExchangeExec" and column in [a.name() for a in _list(node.output())]:
            out.append(node.metrics().apply("numOutputRows").value())
    return out


def _list(seq):
    return [seq.apply(k) for k in range(seq.size())]
