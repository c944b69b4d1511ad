"""Metric records as YAML: a writer and reader for plain mappings, lists and scalars."""

from __future__ import annotations

from typing import Any

from ..functions.seq import format_sigfigs


def dump(value: Any, indent: int = 0) -> str:
    """Block style; keys in their order."""
    pad = "  " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:{_inline(v, indent)}" for k, v in value.items())
    if isinstance(value, list):
        out = ""
        for v in value:
            body = dump(v, indent + 1) if isinstance(v, dict) else f"{'  ' * (indent + 1)}{_scalar(v)}\n"
            out += f"{pad}- {body[len(pad) + 2:]}"
        return out
    return f"{pad}{_scalar(value)}\n"


def _inline(v: Any, indent: int) -> str:
    if isinstance(v, (dict, list)) and v:
        return "\n" + dump(v, indent + (1 if isinstance(v, dict) else 0))
    return f" {'[]' if v == [] else '{}' if v == {} else _scalar(v)}\n"


def _scalar(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if not isinstance(v, str) or (v and v.strip() == v and not set(v) & set(":#{}[],&*?|<>=!%@'\"\n")) else "'" + v.replace("'", "''") + "'"


def load(text: str) -> Any:
    """What :func:`dump` writes, read back."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    value, _ = _block(lines, 0)
    return value


def _block(lines: list[tuple[int, str]], at: int) -> tuple[Any, int]:
    depth = lines[at][0]
    if lines[at][1].startswith("- "):
        out: list = []
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
            body = lines[at][1][2:]
            if ": " in body or body.endswith(":"):
                lines[at] = (depth + 2, body)
                value, at = _block(lines, at)
            else:
                value, at = _parse(body), at + 1
            out.append(value)
        return out, at
    found: dict = {}
    while at < len(lines) and lines[at][0] == depth and not lines[at][1].startswith("- "):
        key, _, rest = lines[at][1].partition(":")
        at += 1
        if rest.strip():
            found[key] = _parse(rest.strip())
        elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- "))):
            found[key], at = _block(lines, at)
        else:
            found[key] = None
    return found, at


def _parse(text: str) -> Any:
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    plain = {"null": None, "true": True, "false": False, "[]": [], "{}": {}}
    if text in plain:
        return plain[text]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def shown(value: Any, sigfigs: int = 3) -> str:
    """One cell of the metrics table: lists in brackets, mappings in braces."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return format_sigfigs(value, sigfigs)
    if isinstance(value, list):
        return "[" + ",".join(shown(v, sigfigs) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{shown(v, sigfigs)}" for k, v in value.items()) + "}"
    return str(value)
