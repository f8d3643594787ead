"""Configuration of the booster."""

from __future__ import annotations

from dataclasses import dataclass

MAX_BINS = 128


@dataclass(frozen=True)
class BoostConfig:
    """Hyper-parameters of a fit.

    ``pack_update`` is "sum" (each of the ``pack_size`` equal trees of a round moves predictions
    by the full learning rate) or "mean" (by its share). ``era_tile_size``,
    ``feature_block_size``, ``enable_node_batching`` and ``device`` are accepted for
    compatibility and have no effect; ``histogram_mode`` only decides the counters of the log.
    """

    pack_size: int = 8
    max_depth: int = 6
    learning_rate: float = 0.1
    lambda_l2: float = 1e-6
    lambda_dro: float = 0.0
    direction_weight: float = 0.0
    min_samples_leaf: int = 20
    max_bins: int = 63
    k_cuts: int = 0
    cut_selection: str = "mass"
    layer_feature_fraction: float = 1.0
    era_alpha: float = 0.0
    era_tile_size: int = 32
    histogram_mode: str = "rebuild"
    feature_block_size: int = 32
    enable_node_batching: bool = True
    random_state: int | None = None
    device: str = "spark"
    prebinned: bool = False
    pack_update: str = "sum"

    def __post_init__(self):
        if not 1 <= self.max_bins <= MAX_BINS:
            raise ValueError(f"max_bins must lie in 1..{MAX_BINS}")
        if self.histogram_mode not in ("rebuild", "subtract", "auto"):
            raise ValueError(f"unknown histogram_mode {self.histogram_mode!r}")
        if self.cut_selection not in ("mass", "even"):
            raise ValueError(f"unknown cut_selection {self.cut_selection!r}")
        if self.pack_update not in ("sum", "mean"):
            raise ValueError(f"unknown pack_update {self.pack_update!r}")
        if self.pack_size < 1 or self.max_depth < 0:
            raise ValueError("pack_size must be positive and max_depth not negative")

    @property
    def tree_weight(self) -> float:
        return self.learning_rate if self.pack_update == "sum" else self.learning_rate / self.pack_size
