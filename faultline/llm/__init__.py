"""Operators for training data made of agent traces and their texts."""
