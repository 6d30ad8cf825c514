"""What a query's plan did, by the metrics of its scans and shuffles."""


def _metrics(df, node, *names):
    """The metrics ``names`` of each ``node`` in the plan of a collected query."""
    done = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == node:
            done.append(tuple(plan.metrics().apply(k).value() for k in names))
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return done


def scans(df):
    """(files, rows) that the file scans of a collected query read."""
    return _metrics(df, "FileSourceScanExec", "numFiles", "numOutputRows")


def shuffled(df):
    """Rows that each shuffle of a collected query wrote."""
    return [n for (n,) in _metrics(df, "ShuffleExchangeExec", "shuffleRecordsWritten")]
