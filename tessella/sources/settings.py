"""Small settings on the driver: arguments, run names, addresses, plans and parameter counts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path


def pairs(items: Iterable[str]) -> list[tuple[str, str]]:
    """name=value arguments, in order (N24); one without a name, a value or the sign is an error."""
    out = []
    for item in items:
        name, sign, value = item.partition("=")
        if not (name and sign and value):
            raise ValueError(f"expected name=value: {item!r}")
        out.append((name, value))
    return out


def layers(raw: str) -> list[int]:
    """Layer indices from 0 of a list such as 7,8."""
    parts = [p.strip() for p in raw.split(",")]
    if not all(re.fullmatch("[0-9]+", p) for p in parts):
        raise ValueError(f"expected non-negative integers parted by commas: {raw!r}")
    return [int(p) for p in parts]


def run_name(prefix: str, indices: Sequence[int] = (), overridden: bool = False, package: str = "full") -> str:
    """The prefix, with package and layers where they differ from the configuration."""
    if package == "full" and not overridden:
        return prefix
    return "-".join([prefix, *([] if package == "full" else [package]), "L" + "-".join(map(str, indices))])


def baseline_name(model: str, family: str) -> str:
    """baseline- and the model's name without its family, small letters and digits only."""
    return "baseline-" + re.sub("[^a-z0-9]", "", re.sub(f"^{re.escape(family)}", "", model, flags=re.IGNORECASE).lower())


def cache_folder(source: str, model: str, seq_len: int, package: str = "full", root: str = "packed") -> str:
    """The folder of a source's packed sequences."""
    return f"{root.rstrip('/')}/{Path(source).stem}__{model.replace('/', '__')}__seq{seq_len}__{package}"


def addresses(base: str, repo: str, files: Iterable[str]) -> list[str]:
    """The addresses of a hosted data set's files."""
    return [f"{base.rstrip('/')}/{repo}/resolve/main/{f}" for f in files]


def model_plan(models: Sequence[Mapping], wanted: Sequence[str] | None = None, resume_from: str | None = None) -> list[Mapping]:
    """The configured models from ``resume_from`` on that are wanted."""
    names = [m["name"] for m in models]
    if resume_from is not None and resume_from not in names:
        raise ValueError(f"{resume_from!r} is no configured model")
    rest = models[names.index(resume_from) if resume_from is not None else 0 :]
    return [m for m in rest if not wanted or m["name"] in wanted]


def parameter_summary(sizes: Iterable[tuple[int, bool]]) -> dict[str, float]:
    """Trainable and all parameters and their percentage, of (size, trainable)."""
    sizes = list(sizes)
    total, learned = sum(n for n, _ in sizes), sum(n for n, on in sizes if on)
    return {"trainable_params": learned, "total_params": total, "trainable_pct": learned / total * 100 if total else 0.0}
