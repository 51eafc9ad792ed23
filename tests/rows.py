"""How many rows the steps of a plan gave, to hold joins to the size of what they join."""


def most_rows(df):
    """df's rows, and the most rows that any step of its plan put out."""
    rows = df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            kids, metrics = p.children(), p.metrics()
            plans += [kids.apply(i) for i in range(kids.size())]
            if metrics.contains("numOutputRows"):
                most = max(most, metrics.apply("numOutputRows").value())
    return rows, most
