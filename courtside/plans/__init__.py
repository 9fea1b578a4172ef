"""Whole plans: training, serving, registered queries."""
