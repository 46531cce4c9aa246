"""Parameters of a sketch, checked when they are made."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass

COUNTER_BITS = (8, 16, 32)


class ConfigError(ValueError):
    """A parameter that no sketch can have."""


class IndexFormatError(ValueError):
    """A stored index that can't be read."""


@dataclass(frozen=True)
class SketchConfig:
    k: int = 31
    m: int = 21
    s: int = 25
    n_hashes: int = 4
    counter_bits: int = 16
    counter_slots_exponent: int = 30
    block_slots_exponent: int = 9
    threads: int = 1
    queue: int = 4096
    segmentation: str = "position"
    #: counters saturate there, or (None) at the greatest value of their width
    counter_cap: int | None = None

    def __post_init__(self) -> None:
        checks = (
            (1 <= self.k <= 32, "a k-mer needs between 1 and 32 bases (k)"),
            (1 <= self.m <= self.k, "minimizers (m) need at least one base and fit into a k-mer"),
            (1 <= self.s <= min(self.k, 32), "s-mers (s) need at least one base and fit into a k-mer"),
            (self.k % 2 == 1, "an even k could equal its own reverse complement; take an odd one"),
            (self.n_hashes > 0, "at least one hash is needed (n_hashes)"),
            (self.counter_bits in COUNTER_BITS, "counters have 8, 16 or 32 bits (counter_bits)"),
            (0 <= self.block_slots_exponent < self.counter_slots_exponent < 63, "a block (block_slots_exponent) has to be smaller than the sketch (counter_slots_exponent, below 63)"),
            (self.threads > 0, "at least one thread is needed (threads)"),
            (self.queue > 0, "the queue holds at least one batch (queue)"),
            (self.segmentation in ("position", "value"), "segmentation must be position or value"),
            (self.counter_cap is None or 0 < self.counter_cap < 1 << self.counter_bits, "a counter's cap has to be positive and fit its width (counter_cap)"),
            (self.segmentation == "position" or self.s % 2 == 1, "segmentation by value needs an odd s"),
        )
        for good, what in checks:
            if not good:
                raise ConfigError(what)
        if self.s % 2 == 0 and self.m % 2 == 0:
            warnings.warn("with s and m both even, k-mers that overlap their own reverse complement may be estimated too low", stacklevel=3)

    @property
    def counter_max(self) -> int:
        return (1 << self.counter_bits) - 1 if self.counter_cap is None else self.counter_cap

    @property
    def counter_slots(self) -> int:
        return 1 << self.counter_slots_exponent

    @property
    def block_slots(self) -> int:
        return 1 << self.block_slots_exponent

    @property
    def blocks(self) -> int:
        return 1 << (self.counter_slots_exponent - self.block_slots_exponent)

    def as_dict(self) -> dict:
        return asdict(self)


def parse_counter_bits(text: str) -> int:
    if text not in ("8", "16", "32"):
        raise ConfigError("counter bits must be 8, 16 or 32")
    return int(text)
