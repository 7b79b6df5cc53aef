"""Options of a detection run: validation, JSON form, output path."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from typing import Any

#: Short names of fields and their names in JSON files.
LONG_NAMES = {
    "noise_t": "noise_threshold", "guarantee_t": "guarantee_threshold", "display_t": "display_threshold",
    "test_dirs": "test_directories", "ref_dirs": "reference_directories", "boilerplate_dirs": "boilerplate_directories",
}
_LISTS = ("test_dirs", "ref_dirs", "boilerplate_dirs", "extensions", "css_files")
_BOOLS = ("same_name_only", "ignore_leaf", "autoopen", "disable_filtering", "truncate", "silent")
_INTS = ("noise_t", "guarantee_t")


@dataclass(frozen=True)
class Config:
    test_dirs: list[str] = field(default_factory=list)
    ref_dirs: list[str] = field(default_factory=list)
    boilerplate_dirs: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: ["*"])
    noise_t: int = 25
    guarantee_t: int = 25
    display_t: float = 0.33
    same_name_only: bool = False
    ignore_leaf: bool = False
    autoopen: bool = True
    disable_filtering: bool = False
    force_language: str | None = None
    truncate: bool = False
    out_file: str = "./report.html"
    css_files: list[str] = field(default_factory=list)
    silent: bool = False
    encoding: str = "utf-8"

    def __post_init__(self) -> None:
        for name in _INTS:
            value = getattr(self, name)
            if isinstance(value, float) and value.is_integer():
                object.__setattr__(self, name, int(value))
        if not self.ref_dirs:
            object.__setattr__(self, "ref_dirs", list(self.test_dirs))
        self._check_types()
        self._check_values()
        object.__setattr__(self, "out_file", report_path(self.out_file))

    @property
    def window_size(self) -> int:
        return self.guarantee_t - self.noise_t + 1

    def _check_types(self) -> None:
        wrong = [f"{n} must be a list" for n in _LISTS if not isinstance(getattr(self, n), list)]
        wrong += [f"{n} must be true or false" for n in _BOOLS if not isinstance(getattr(self, n), bool)]
        wrong += [f"{n} must be an integer" for n in _INTS if not isinstance(getattr(self, n), int) or isinstance(getattr(self, n), bool)]
        wrong += [f"{n} must be a string" for n in ("out_file", "encoding") if not isinstance(getattr(self, n), str)]
        if not (self.force_language is None or isinstance(self.force_language, str)):
            wrong.append("force_language must be a string")
        if not isinstance(self.display_t, (int, float)) or isinstance(self.display_t, bool):
            wrong.append("display_t must be a number")
        if wrong:
            raise TypeError("; ".join(wrong))

    def _check_values(self) -> None:
        if self.noise_t < 1:
            raise ValueError("the noise threshold must be at least 1")
        if self.guarantee_t < self.noise_t:
            raise ValueError("the guarantee threshold must not be below the noise threshold")
        if not 0 <= self.display_t <= 1:
            raise ValueError("the display threshold must be between 0 and 1")
        parent = os.path.dirname(os.path.abspath(self.out_file))
        if not os.path.isdir(parent):
            raise ValueError(f"the report's folder does not exist: {parent}")

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> Config:
        """From JSON names (long or short); the caller's dict stays as it is."""
        short = {v: k for k, v in LONG_NAMES.items()} | {"css": "css_files"}
        values = {short.get(k, k): v for k, v in given.items() if k != "window_size"}
        if "disable_autoopen" in values:
            values["autoopen"] = not values.pop("disable_autoopen")
        unknown = set(values) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**values)

    @classmethod
    def from_json(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def to_dict(self) -> dict[str, Any]:
        """JSON names, re-readable by from_dict; no language is left out."""
        out = {LONG_NAMES.get(k, k): v for k, v in dataclasses.asdict(self).items() if not (k == "force_language" and v is None)}
        out["disable_autoopen"] = not out.pop("autoopen")
        return out


def report_path(path: str) -> str:
    """A folder gets report.html; a path without that suffix gets it."""
    if os.path.isdir(path):
        return os.path.join(path, "report.html")
    return path if path.endswith(".html") else f"{path}.html"
