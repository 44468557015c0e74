"""What a finished query ran."""


def ran(df):
    """The text of a collected frame's plan without what was planned at first."""
    return "\n".join(_final(df._jdf.queryExecution().executedPlan().toString()))


def _final(plan):
    hidden = None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :|+-"))
        if hidden is not None and depth < hidden:
            hidden = None
        if hidden is None and "== Initial Plan ==" in line:
            hidden = depth
        if hidden is None:
            yield line
