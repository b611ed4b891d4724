import builtins
import importlib
import sys

import pytest


def test_a_missing_library_leaves_out_its_queries_alone(monkeypatch):
    from quietlines.llm import queries

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "regex":
            raise ImportError("No module named 'regex'", name="regex")
        return real(name, *args, **kwargs)

    for name in ("quietlines.llm.tokens", "quietlines.llm.packing", "regex"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setattr(builtins, "__import__", without)
    try:
        with pytest.warns(UserWarning, match="regex"):
            importlib.reload(queries)
        names = set(queries.queries())
        assert "p1_found" in names and "p8_found" in names and not names & {"p6_ids", "p7_containers"}
    finally:
        monkeypatch.undo()
        importlib.reload(queries)
    assert "p6_ids" in queries.queries()
