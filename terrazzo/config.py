"""Configuration files as attribute dictionaries."""

from __future__ import annotations

import json


class Config(dict):
    """A dictionary whose keys are attributes too; a missing one names itself."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(f"no setting {name!r}") from None


def _nested(value):
    if isinstance(value, dict):
        return Config({k: _nested(v) for k, v in value.items()})
    return [_nested(v) for v in value] if isinstance(value, list) else value


def parsed(text: str) -> Config:
    """YAML where a YAML library is installed, else JSON."""
    try:
        import yaml
    except ImportError:
        return _nested(json.loads(text))
    return _nested(yaml.safe_load(text))


def load(path: str) -> Config:
    with open(path) as file:
        return parsed(file.read())
