"""DataFrame -> DataFrame operators.  None of them collects data rows to the
driver; where a scalar (a count, min/max, a few quantile bounds) is needed to
build the next plan, only that scalar is fetched."""
