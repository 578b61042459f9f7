"""Rule packs and trust policies from TOML, with inheritance."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

#: names of packs and rules (fixed pattern) and the conditions a rule may state
NAME = re.compile(r"^[a-z][a-z0-9-]*$")
CONDITIONS = ("sources.missing", "verified.pending", "redaction.proposed", "diagnostics.present", "readiness.not_ready", "stale.expired")
SEVERITIES = ("error", "warning", "info")


class PolicyError(ValueError):
    """A pack or policy file is not valid."""


def load_pack(path: str | Path, _seen: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(rule, severity, condition) of a pack file; ``extends`` names sibling files, parents' rules come first."""
    path = Path(path)
    if path.stem in _seen:
        raise PolicyError(f"cycle: {' -> '.join((*_seen, path.stem))}")
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise PolicyError(f"{path.name}: {e}") from e
    if not NAME.match(str(data.get("id", path.stem))):
        raise PolicyError(f"{path.name}: bad pack name")
    rules: list[tuple[str, str, str]] = []
    parents = data.get("extends", [])
    for parent in [parents] if isinstance(parents, str) else parents:
        rules += load_pack(path.with_name(f"{parent}.toml"), (*_seen, path.stem))
    for rule in data.get("rules", []):
        name, severity, condition = str(rule.get("id", "")), str(rule.get("severity", "warning")), str(rule.get("condition", ""))
        if not NAME.match(name) or severity not in SEVERITIES or condition not in CONDITIONS:
            raise PolicyError(f"{path.name}: bad rule {name!r}")
        rules.append((name, severity, condition))
    names = [r[0] for r in rules]
    if len(names) != len(set(names)):
        raise PolicyError(f"{path.name}: a rule is given twice")
    return rules


def load_policy(path: str | Path) -> dict[str, tuple[str, ...]]:
    """Allowed types, statuses and verifications; absent ones admit any value that is not empty."""
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("trust", {})
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise PolicyError(str(e)) from e
    out = {}
    for key in ("types", "statuses", "verified"):
        value = data.get(key, ["*"])
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise PolicyError(f"{key} must be a list of strings")
        out[key] = tuple(value)
    return out
