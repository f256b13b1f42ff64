"""Rule checks: measurements in, verdicts and events out.

Row-wise checks add a verdict and can list their events; checks over many
events of a file reduce them with one map-side combined aggregation.
"""
