"""Stateful stream operators: think tags, event framing, limits, delivery guards."""
