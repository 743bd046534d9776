"""Configuration of rules, from a small subset of YAML read on the driver.

Sections are `Department/Rule` and `AllCops`; a setting is a scalar, a list in
brackets or of dashed lines, or a map of one level. All values are strings. Later
files replace settings key by key; maps are merged. `Enabled` selects nothing.
"""

from __future__ import annotations

import dataclasses
import re

SECTION = re.compile(r"([A-Z]\w*/[A-Z]\w*|AllCops):\s*")
SETTING = re.compile(r"(\s+)([^\s:#-][^:]*):(?:\s+(.*))?")
Value = str | list[str] | dict[str, str]


def _scalar(text: str) -> str:
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    return re.sub(r"\s+#.*", "", text).strip()


def parse_config(text: str) -> dict[str, dict[str, Value]]:
    out: dict[str, dict[str, Value]] = {}
    section, key, depth = None, None, 0
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace():
            head = SECTION.fullmatch(re.sub(r"\s+#.*", "", line))
            section, key = (out.setdefault(head[1], {}) if head else None), None
            continue
        if section is None:
            continue
        item = re.fullmatch(r"\s+-\s+(.*)", line)
        if item and key is not None:
            held = section[key]
            section[key] = [*(held if isinstance(held, list) else []), _scalar(item[1])]
            continue
        setting = SETTING.fullmatch(line)
        if not setting:
            continue
        indent, name, value = len(setting[1]), _scalar(setting[2]), _scalar(setting[3] or "")
        if key is not None and indent > depth:
            held = section[key]
            section[key] = {**(held if isinstance(held, dict) else {}), name: value}
            continue
        key, depth = name, indent
        section[key] = [v for v in map(_scalar, value[1:-1].split(",")) if v] if value[:1] == "[" and value[-1:] == "]" else value
    return out


def merged(*configs: dict[str, dict[str, Value]]) -> dict[str, dict[str, Value]]:
    out: dict[str, dict[str, Value]] = {}
    for config in configs:
        for rule, settings in config.items():
            mine = out.setdefault(rule, {})
            for k, v in settings.items():
                mine[k] = {**mine[k], **v} if isinstance(v, dict) and isinstance(mine.get(k), dict) else v
    return out


def configured(rules: tuple, config: dict[str, dict[str, Value]]) -> tuple:
    """Rules with the values that the configuration has for their options. A
    value that isn't like the default (a number where that is one) is left out."""
    out = []
    for r in rules:
        options = getattr(r, "options", None)
        told = config.get(r.name, {})
        taken = {k: told[k] for k, v in (options or {}).items() if isinstance(told.get(k), str) and (not v.isdecimal() or told[k].isdecimal()) and re.fullmatch(r"\w+", told[k])}
        out.append(dataclasses.replace(r, options={**options, **taken}) if taken else r)
    return tuple(out)


def ruby_version(config: dict[str, dict[str, Value]]) -> tuple[int, int]:
    found = re.match(r"(\d+)\.(\d+)", str(config.get("AllCops", {}).get("TargetRubyVersion", "")))
    return (int(found[1]), int(found[2])) if found else (2, 7)
