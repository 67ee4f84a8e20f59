"""DataFrame operators: periods, flows, reconciliation, recipes, P&L, pivots."""
