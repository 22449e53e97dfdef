"""Parameters of the pipelines with their default values (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preprocess:
    factor: float = 1
    voxel_res: tuple = (1, 1, 1)
    do_bg_correction: bool = True
    bg_ds: int = 16
    bg_sigma: float = 5
    normalize_min: float = 2.0
    normalize_max: float = 99.8


@dataclass(frozen=True)
class CombineGradients:
    ksize: int = 1
    alpha: float = 0.5
    eps: float = 1e-20
    smooth_sigma: float = 1
    post_sigma: float = 0


@dataclass(frozen=True)
class CombineProbs:
    ksize: int = 1
    alpha: float = 0.5
    eps: float = 1e-20
    logits: bool = True
    smooth_sigma: float = 0
    threshold_level: int = 1
    threshold_n_levels: int = 3
    one_decimal: bool = True
    prob_thresh: float | None = None
    min_prob_thresh: float = 0.0


@dataclass(frozen=True)
class Binary:
    closing: int = 1
    remove_small: int = 1000
    dilation: int = 1
    fill_holes: bool = False
    extra_erode: int = 0


@dataclass(frozen=True)
class Descent:
    decay: float = 0.0
    tiled: bool = False
    tile_shape: tuple = (128, 256, 256)
    overlap: float = 0.25
    n_iter: int = 200
    delta: float = 1.0
    momentum: float = 0.98
    interp: bool = False
    renorm: bool = False


@dataclass(frozen=True)
class Cluster:
    smooth_sigma: float = 1.0
    thresh_factor: float | None = 0


@dataclass(frozen=True)
class Indirect:
    method: str = "poisson"
    iter_factor: int = 5
    power: float | None = None
    quantile: float = 0.01
    smooth_binary: float = 1
    skel_sigma: float = 3


@dataclass(frozen=True)
class Aggregation:
    gradients: CombineGradients = field(default_factory=CombineGradients)
    probs: CombineProbs = field(default_factory=CombineProbs)
    binary: Binary = field(default_factory=Binary)
    descent: Descent = field(default_factory=Descent)
    cluster: Cluster = field(default_factory=Cluster)
    indirect: Indirect = field(default_factory=Indirect)


@dataclass(frozen=True)
class Postprocess:
    min_size: int = 200
    max_size: int | None = None
    max_size_factor: float = 10
    do_stats_filter: bool = True
    do_flow_remove: bool = True
    flow_threshold: float = 0.85
    method: str = "poisson"
    quantile: float = 0.01
