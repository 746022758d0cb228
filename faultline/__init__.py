"""Faultline: a PySpark-native engine for root-cause analysis of agent execution traces."""

__version__ = "0.1.0"
