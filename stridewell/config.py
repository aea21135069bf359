"""Constants of the evaluation, in one place; importing this has no side effects."""

from __future__ import annotations

from dataclasses import dataclass

# Activity codes, tasks, modes and protocols.
FALL_CODES = ("BSC", "FKL", "FOL", "SDL")
ADL_CODES = ("STD", "WAL", "JOG", "JUM", "STU", "STN", "SCH", "SIT", "CHU", "CSI", "CSO")
ALL_CODES = FALL_CODES + ADL_CODES
CHANNELS = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")
TASKS = {"binary": ALL_CODES, "adl_only": ADL_CODES, "fall_only": FALL_CODES, "flat15": ALL_CODES}
MODES = ("erm", "sam", "fic", "sam_fic")
PROTOCOLS = ("cv", "loso")


@dataclass(frozen=True)
class Settings:
    native_hz: float = 200.0
    target_hz: float = 50.0
    win: int = 50
    step: int = 25
    epochs: int = 30
    batch: int = 512
    lr: float = 1e-3
    weight_decay: float = 1e-4
    seeds_cv: tuple[int, ...] = (0, 1, 2)
    seeds_loso: tuple[int, ...] = (0,)
    folds: int = 5
    rho: float = 0.05
    consistency_weight: float = 0.3
    var_threshold: float = 1e-6
    corr_threshold: float = 0.95

    @property
    def ratio(self) -> float:
        return self.native_hz / self.target_hz


DEFAULTS = Settings()
