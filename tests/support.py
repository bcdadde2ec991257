"""Constants and helpers that several test modules share."""

SF_SMALL = "/root/testdata/sf0.001"


def scans(plan):
    """File scans of an executed plan, through adaptive stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(plan.plan())
    found = [plan] if name == "FileSourceScanExec" else []
    children = plan.children().iterator()
    while children.hasNext():
        found += scans(children.next())
    return found


def files_read(df) -> int:
    """Files that the scans of ``df`` open, subqueries left out."""
    df.collect()
    return sum(int(s.metrics().apply("numFiles").value()) for s in scans(df._jdf.queryExecution().executedPlan()))


def rows_scanned(df) -> int:
    """Rows that the file scans of ``df`` hand on, before any filter above them."""
    df.collect()
    return sum(int(s.metrics().apply("numOutputRows").value()) for s in scans(df._jdf.queryExecution().executedPlan()))
