"""Settings that shape output, read once on the driver and put into plans as literals."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Sheet size and physical floors in millimetres.
SHEET_WIDTH_MM, SHEET_HEIGHT_MM = 210.0, 297.0
MIN_TEXT_MM, MIN_QR_MM = 2.2, 25.0
MM_PER_INCH, POINTS_PER_INCH = 25.4, 72.0
EPSILON = 1e-7


@dataclass(frozen=True)
class Settings:
    """Margins 12 to 15 mm, gaps 6 to 10 mm, 200 to 600 dpi; anything else is refused."""

    page_margin_mm: float = 13.5
    item_gap_mm: float = 8.0
    render_dpi: int = 300
    max_files: int = 10_000
    max_bytes: int = 2 * 1024**3
    max_depth: int = 3

    def __post_init__(self):
        for name, low, high in (("page_margin_mm", 12, 15), ("item_gap_mm", 6, 10), ("render_dpi", 200, 600)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is between {low} and {high}")

    @property
    def usable_width(self) -> float:
        return SHEET_WIDTH_MM - 2 * self.page_margin_mm

    @property
    def usable_height(self) -> float:
        return SHEET_HEIGHT_MM - 2 * self.page_margin_mm

    @classmethod
    def from_environment(cls, prefix: str = "SHEAF_") -> Settings:
        known = {f.name: f for f in fields(cls)}
        given = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
        if unknown := given.keys() - known.keys():
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: type(known[k].default)(v) for k, v in given.items()})
