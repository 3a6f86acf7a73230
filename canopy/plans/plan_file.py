"""Edit plans from YAML, decoded strictly: keys that are not known are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canopy.functions.edit_rules import Action
from canopy.functions.gotext import EngineError
from canopy.operators.edits import actions_frame
from canopy.plans.corpus import Corpus

#: The keys of an action.
KEYS = {"action": str, "file": str, "package": str, "identifier": str, "content": str, "mock_file": str, "mock_name": str, "doc": str, "strip_doc": bool}


def read_plan(text: str) -> list[Action]:
    try:
        import yaml
    except ImportError as e:
        raise EngineError("INTERNAL_ERROR", "plans in YAML need the yaml library") from e
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise EngineError("PARSE_ERROR", f"failed to parse plan: {e}") from e
    if data is None:
        return []
    if not isinstance(data, dict):
        raise EngineError("PARSE_ERROR", "a plan is a mapping with the key actions")
    if unknown := sorted(map(str, set(data) - {"actions"})):
        raise EngineError("PARSE_ERROR", f"unknown fields in plan: {', '.join(unknown)}")
    out = []
    for i, item in enumerate(data["actions"] or []):
        if not isinstance(item, dict):
            raise EngineError("PARSE_ERROR", f"action {i} is not a mapping")
        if unknown := sorted(map(str, set(item) - set(KEYS))):
            raise EngineError("PARSE_ERROR", f"unknown fields in action {i}: {', '.join(unknown)}")
        for key, value in item.items():
            if value is not None and not isinstance(value, KEYS[key]):
                raise EngineError("PARSE_ERROR", f"action {i}: {key} is not a {KEYS[key].__name__}")
        values = {k: v for k, v in item.items() if v is not None}
        out.append(Action(values.pop("action", ""), values.pop("file", ""), **values))
    return out


def plan_frame(corpus: Corpus, text: str, repo: str | None = None) -> DataFrame:
    """The actions of a plan as rows, for execute_plan."""
    return actions_frame(corpus, read_plan(text), repo)
