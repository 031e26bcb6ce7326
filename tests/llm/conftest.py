import pytest

from tessera.llm import pieces


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    """Tables of a few rows need no 64 tasks."""
    monkeypatch.setattr(pieces, "HEAD_TASKS", 4)
