"""The user's choices for a cleaning run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..operators.columns import DATE_MODES, EMAIL_MODES
from ..operators.impute import check_strategy
from ..operators.outliers import TREATMENTS

_FORM_PREFIX = "strategy_"


@dataclass(frozen=True)
class Overrides:
    """Per-column choices; anything not named takes its default.

    ``fill`` is Auto (default), Skip, Drop, Median, Mean, Mode or ``Custom:<value>``; ``email_modes`` is
    flag (default), nullify or remove; ``date_modes`` is nullify (default), standardize or keep;
    ``outliers`` is clip (default), median_replace or remove_row.
    """

    fill: Mapping[str, str] = field(default_factory=dict)
    email_modes: Mapping[str, str] = field(default_factory=dict)
    date_modes: Mapping[str, str] = field(default_factory=dict)
    outliers: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, choices: Mapping[str, str] | Overrides | None, columns: list[str]) -> Overrides:
        """Read flat choices: ``<col>`` or ``strategy_<col>``, ``email_mode_<col>``, ``date_mode_<col>``,
        ``outlier_<col>``. A key that is itself a column name is a fill strategy."""
        if isinstance(choices, Overrides):
            return choices
        groups: dict[str, dict[str, str]] = {"email_mode_": {}, "date_mode_": {}, "outlier_": {}}
        fill: dict[str, str] = {}
        for key, value in (choices or {}).items():
            prefix = next((p for p in groups if key.startswith(p) and key not in columns), None)
            if prefix:
                groups[prefix][key[len(prefix):]] = value
            elif key.startswith(_FORM_PREFIX) and key not in columns:
                fill[key[len(_FORM_PREFIX):]] = value
            else:
                fill[key] = value
        made = cls(fill, groups["email_mode_"], groups["date_mode_"], groups["outlier_"])
        for given, known, what in (
            (made.email_modes, EMAIL_MODES, "e-mail mode"),
            (made.date_modes, DATE_MODES, "date mode"),
            (made.outliers, TREATMENTS, "outlier treatment"),
        ):
            for name, value in given.items():
                if value not in known:
                    raise ValueError(f"unknown {what} for {name!r}: {value!r}")
        return made

    @property
    def dropped(self) -> list[str]:
        return [c for c, s in self.fill.items() if s == "Drop"]

    def check_fill(self, kinds: Mapping[str, str]) -> None:
        for name, strategy in self.fill.items():
            if name in kinds:
                check_strategy(name, kinds[name], strategy)
