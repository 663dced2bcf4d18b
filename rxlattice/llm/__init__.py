"""Operators for preparing training text at cluster scale.

Nothing outside this package imports it; `queries` lists what it registers.
"""
