"""Settings of a run, with the values that the pipeline uses when none are given."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    min_length: int = 5000  # blocks with a shorter first sequence are skipped
    truncate: int = 100_000  # pieces of a genome
    min_region: int = 50  # gaps in a valid region that are bridged
    wave_window_size: int = 100
    wave_window_step: int = 100
    vicinal_size: int = 500
    fall_range: float = 0.1
    gsw_size: int = 100
    stat_window_size: int = 100
    stat_window_step: int = 100
    stat_segment_size: int = 500
    near: int = 100  # bases within which SNPs count as neighbours
    combine_threshold: int = 1000
    piece: int = 100_000
    segment_piece: int = 500_000
    standalone: tuple[int, ...] = (-1, 0)
    last_portion: float = 0.05
    segment_styles: dict[int, int] = field(default_factory=lambda: {1: 5000, 2: 1000, 3: 500})
