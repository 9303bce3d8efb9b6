"""Settings of the engine, one frozen dataclass a concern."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GridConfig:
    tile_size: int = 512
    overlap: int = 32
    scale: int = 4
    min_tissue: float = 0.1
    brightness: float = 220.0


@dataclass(frozen=True)
class BlendConfig:
    """``sigma`` near a quarter of a tile keeps the weights above the floor all over it."""

    sigma: float = 64.0
    weight_floor: float = 1e-8
    strip_factor: int = 16


@dataclass(frozen=True)
class ScreenConfig:
    tile_size: int = 2048
    overlap: int = 128
    min_side: int = 64
    min_score: float = 0.5
    mask_threshold: float = 0.5
    nms_iou: float = 0.5


@dataclass(frozen=True)
class ShapeConfig:
    """Thresholds below or above which a descriptor counts against an object, their weights, and gates."""

    circularity: float = 0.55
    aspect_ratio: float = 3.0
    roughness: float = 0.4
    solidity: float = 0.7
    weights: tuple[float, float, float, float] = (0.35, 0.25, 0.25, 0.15)
    abnormal_score: float = 0.6
    min_area: float = 100.0
    max_area: float = 50000.0
    min_points: int = 3


@dataclass(frozen=True)
class StoreConfig:
    """``folders``: the most slides of one batch that get a folder each."""

    dim: int = 10
    top_k: int = 20
    lists: int = 1024
    probes: int = 64
    limit: int = 100
    folders: int = 128


@dataclass(frozen=True)
class IngestConfig:
    """Suffixes and the largest size of an upload that is admitted."""

    suffixes: tuple[str, ...] = (".svs", ".tiff", ".tif")
    max_bytes: int = 100 << 30
    target_mpp: float = 0.25
    batch_tiles: int = 32


@dataclass(frozen=True)
class EngineConfig:
    grid: GridConfig = field(default_factory=GridConfig)
    blend: BlendConfig = field(default_factory=BlendConfig)
    screen: ScreenConfig = field(default_factory=ScreenConfig)
    shape: ShapeConfig = field(default_factory=ShapeConfig)
    store: StoreConfig = field(default_factory=StoreConfig)
    ingest: IngestConfig = field(default_factory=IngestConfig)
