"""Settings from ``.env`` files."""

from __future__ import annotations

import os
from pathlib import Path


class SettingError(ValueError):
    """A setting is missing or malformed."""


def read_env(path: str | Path) -> dict[str, str]:
    """``key=value`` lines; blank lines and lines that begin with # are skipped, a pair of quotes around a value goes."""
    path = Path(path)
    if not path.is_file():
        raise SettingError(f"no settings file: {path}")
    out = {}
    for line in path.read_text(encoding="utf-8").splitlines():
        key, equals, value = line.strip().partition("=")
        if not equals or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.strip()] = value
    return out


def required(settings: dict[str, str], key: str) -> str:
    if not settings.get(key, "").strip():
        raise SettingError(f"{key} is needed")
    return settings[key]


def whole_number(settings: dict[str, str], key: str, default: int | None = None, least: int = 0) -> int | None:
    text = settings.get(key, "").strip()
    if not text:
        return default
    try:
        value = int(text)
    except ValueError as problem:
        raise SettingError(f"{key} must be a whole number") from problem
    if value < least:
        raise SettingError(f"{key} must be {least} or more")
    return value


#: What names a model's revision, the first that is set (fixed values).
REVISIONS = {"siglip2": ("SIGLIP2_REVISION",), "clip": ("OPENAI_CLIP_REVISION", "CLIP_REVISION")}


def revision(model_id: str, default: str | None, env_file: str | Path = ".env") -> str | None:
    """A model's revision: what the environment names, or else the settings file, if there is one, or else the pinned one."""
    stated = read_env(env_file) if Path(env_file).is_file() else {}
    for place in (os.environ, stated):
        for key in REVISIONS[model_id]:
            if place.get(key, "").strip():
                return place[key].strip()
    return default
