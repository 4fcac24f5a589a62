"""Composable DataFrame transforms: joins, statistics, windows, survival, sampling, evaluation, space."""
