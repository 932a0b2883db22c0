"""The grid and its geometry as column expressions; all of them stay inside generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longitudes and latitudes that the grid covers.
WEST, SOUTH, WIDTH, HEIGHT = -180.0, -90.0, 360.0, 180.0
#: Texts of x that count as numbers.
NUMBER = r"^-?[0-9]+([.][0-9]+)?$"


@dataclass(frozen=True)
class Grid:
    """2**theta cells on each axis."""

    theta: int = 12

    @property
    def side(self) -> int:
        return 1 << self.theta

    def cx(self, lng: Column) -> Column:
        return F.floor((lng - WEST) / F.lit(WIDTH / self.side)).cast("long")

    def cy(self, lat: Column) -> Column:
        return F.floor((lat - SOUTH) / F.lit(HEIGHT / self.side)).cast("long")

    def cell_id(self, cx: Column, cy: Column) -> Column:
        """Row by row."""
        return cy * F.lit(self.side).cast("long") + cx

    def resolve(self, cell_id: Column) -> tuple[Column, Column]:
        """cx and cy of a cell."""
        return cell_id.bitwiseAND(F.lit(self.side - 1).cast("long")), F.shiftright(cell_id, self.theta)

    def lower_left(self, cx: Column, cy: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a cell's lower left corner."""
        return cx * F.lit(WIDTH / self.side) + WEST, cy * F.lit(HEIGHT / self.side) + SOUTH

    def inside(self, lng: Column, lat: Column) -> Column:
        """Strictly within the extent."""
        return (lng > WEST) & (lng < WEST + WIDTH) & (lat > SOUTH) & (lat < SOUTH + HEIGHT)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def boxes_meet(a: str, b: str, reach: int = 0) -> Column:
    """Closed boxes (columns a_min_cx ... b_max_cy) meet after widening one by reach cells."""
    near = [(F.col(f"{a}min_{c}") <= F.col(f"{b}max_{c}") + reach) & (F.col(f"{b}min_{c}") <= F.col(f"{a}max_{c}") + reach) for c in ("cx", "cy")]
    return near[0] & near[1]


def boxes_equal(a: str, b: str) -> Column:
    """All four bounds are the same."""
    same = [F.col(f"{a}{m}_{c}").eqNullSafe(F.col(f"{b}{m}_{c}")) for m in ("min", "max") for c in ("cx", "cy")]
    return same[0] & same[1] & same[2] & same[3]


def box_contains(a: str, b: str) -> Column:
    """Box b lies within box a."""
    parts = [(F.col(f"{a}min_{c}") <= F.col(f"{b}min_{c}")) & (F.col(f"{a}max_{c}") >= F.col(f"{b}max_{c}")) for c in ("cx", "cy")]
    return parts[0] & parts[1]


def common_box(a: str, b: str) -> dict[str, Column]:
    """Bounds of the common box; empty if a minimum exceeds its maximum."""
    out = {}
    for c in ("cx", "cy"):
        out[f"min_{c}"] = F.greatest(F.col(f"{a}min_{c}"), F.col(f"{b}min_{c}"))
        out[f"max_{c}"] = F.least(F.col(f"{a}max_{c}"), F.col(f"{b}max_{c}"))
    return out


def common_cells(a: str, b: str) -> Column:
    """Number of cells of the common box, 0 if there is none."""
    box = common_box(a, b)
    w, h = (box[f"max_{c}"] - box[f"min_{c}"] + 1 for c in ("cx", "cy"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0).cast("long"))


def common_area(a: str, b: str) -> Column:
    """Area of the common rectangle of two real rectangles, without counting cells."""
    box = common_box(a, b)
    w, h = (box[f"max_{c}"] - box[f"min_{c}"] for c in ("cx", "cy"))
    return F.when((w > 0) & (h > 0), (w * h).cast("double")).otherwise(F.lit(0.0))


def ball_gap(a: str, b: str) -> Column:
    """Distance between the balls around two boxes; negative if they overlap."""
    d = distance(F.col(f"{a}pivot_x"), F.col(f"{a}pivot_y"), F.col(f"{b}pivot_x"), F.col(f"{b}pivot_y"))
    return d - F.col(f"{a}radius") - F.col(f"{b}radius")
