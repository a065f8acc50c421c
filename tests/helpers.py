"""Helpers shared by the core tests (not by ``tests/llm``)."""
import datetime as dt


def D(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)
