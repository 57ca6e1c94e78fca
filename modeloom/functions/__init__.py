"""Numeric kernels for one recording or window at a time, run inside Arrow functions."""
