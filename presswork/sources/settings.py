"""Configuration on the driver: defaults, a file's values over them, environment names expanded, dotted access."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

# Defaults.
DEFAULTS: dict[str, Any] = {
    "defaults": {"feed_items": 10, "concurrency": 2, "scrape_delay": {"lower_sec": 2, "upper_sec": 5}, "max": 100, "follow": 3, "schedule": "0 */6 * * *", "jitter_sec": 1800, "feed_source": "tags", "store_raw": True},
    "http": {"timeout_sec": 60},
}


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """`over` on `base`, object by object; lists and values are replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def expand(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """`${NAME}` in all texts replaced from the environment; unknown names become empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value)
    if isinstance(value, Mapping):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def coerce(text: str) -> bool | int | float | str:
    """A command-line value as what it looks like."""
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def get(config: Mapping[str, Any], dotted: str) -> Any:
    for part in dotted.split("."):
        config = config.get(part) if isinstance(config, Mapping) else None
    return config


def put(config: Mapping[str, Any], dotted: str, value: Any) -> dict[str, Any]:
    for part in reversed(dotted.split(".")):
        value = {part: value}
    return merge(config, value)


def load(text: str, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """A JSON document over the defaults (YAML where a parser is installed)."""
    import json

    try:
        own = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML parser is installed") from e
        own = yaml.safe_load(text) or {}
    return merge(DEFAULTS, expand(own, env))
