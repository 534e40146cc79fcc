"""Parameters. Lengths are whole millimetres: sums of whole numbers come out alike for any partitioning."""

from __future__ import annotations

from dataclasses import dataclass

#: Weights are whole multiples of 1 / WEIGHT_ONE; unit normals of 1 / NORMAL_ONE.
WEIGHT_ONE = 1 << 24
NORMAL_ONE = 1_000_000
PREVIEW, REFINED = 0, 1
BASE = -1  # the layer of refined segments


@dataclass(frozen=True)
class Config:
    voxel: int = 200
    block_dim: int = 32
    bin: int = 100
    splat_radius: int = 400
    min_weight: float = 0.5
    normal_radius_bins: int = 2
    normal_min_neighbors: int = 6
    orient_radius: int = 2
    seed_nz: float = 0.7
    crease: float = 0.3
    oracle_min: float = 0.3
    simplify_error: int = 0

    def __post_init__(self) -> None:
        if self.block_dim <= 0 or self.block_dim % 8:
            raise ValueError("block_dim must be a positive multiple of 8")

    @property
    def min_weight_units(self) -> int:
        return int(self.min_weight * WEIGHT_ONE)
