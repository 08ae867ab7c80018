"""Differentially private measure-select-estimate loops."""
