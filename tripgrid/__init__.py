"""tripgrid: hourly demand grids, OD matrices and forecasts from shared-vehicle trips.

The package is a set of DataFrame operators (``operators``), column functions
(``functions``), readers and writers (``sources``) and jobs that chain them
(``plans``).
"""
