"""Operators of a training-data pipeline. Nothing else in the library imports this.

QUERIES and ORACLE are only loaded when asked for: a worker that needs one operator doesn't import them all."""

__all__ = ["ORACLE", "QUERIES"]


def __getattr__(name: str):
    if name not in __all__:
        raise AttributeError(name)
    from sparkloom.llm import queries

    return getattr(queries, name)
