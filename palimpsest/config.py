"""Configuration of a store: defaults, TOML files, overrides from the environment, and checks."""

from __future__ import annotations

import math
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from .operators.compaction import CompactionPolicy

PREFIX = "PALIMPSEST__"


@dataclass(frozen=True)
class StoreSection:
    """Buckets of the key index, bytes of the hot log and of a page (as a power of two), and the share of the hot log that changes in place."""

    table_size: int = 1 << 20
    log_memory_size: int = 1 << 30
    page_size_bits: int = 25
    mutable_fraction: float = 0.9


@dataclass(frozen=True)
class CompactionSection:
    target_utilization: float = 0.5
    min_compact_bytes: int = 1 << 20
    max_compact_bytes: int = 1 << 30
    per_hour: int = 12
    quiet_seconds: float = 5.0


@dataclass(frozen=True)
class CacheSection:
    """The read cache holds at most ``mem_size`` bytes of records."""

    enabled: bool = False
    mem_size: int = 256 << 20


@dataclass(frozen=True)
class CheckpointSection:
    """``snapshot`` copies rows, ``foldover`` names a range of the log; ``fsync`` reads a checkpoint's rows back before its manifest counts."""

    backend: str = "snapshot"
    durability: str = "fsync"


@dataclass(frozen=True)
class Config:
    store: StoreSection = field(default_factory=StoreSection)
    compaction: CompactionSection = field(default_factory=CompactionSection)
    cache: CacheSection = field(default_factory=CacheSection)
    checkpoint: CheckpointSection = field(default_factory=CheckpointSection)

    def check(self) -> Config:
        """This configuration; ValueError for what no store can work with."""
        s, c, k = self.store, self.compaction, self.checkpoint
        for wrong, text in (
            (s.table_size <= 0 or s.table_size & (s.table_size - 1) or s.table_size >= 1 << 31, "store.table_size must be a power of two below 2**31"),
            (not 10 <= s.page_size_bits <= 30, "store.page_size_bits must lie between 10 and 30"),
            (s.log_memory_size <= 1 << s.page_size_bits, "store.log_memory_size must be larger than a page"),
            (math.isnan(s.mutable_fraction), "store.mutable_fraction is not a number"),
            (not 0 <= c.target_utilization <= 1, "compaction.target_utilization must lie between 0 and 1"),
            (c.min_compact_bytes > c.max_compact_bytes, "compaction.min_compact_bytes exceeds max_compact_bytes"),
            (k.backend not in ("snapshot", "foldover"), "checkpoint.backend must be snapshot or foldover"),
            (k.durability not in ("plain", "fsync"), "checkpoint.durability must be plain or fsync"),
        ):
            if wrong:
                raise ValueError(text)
        return self

    def policy(self) -> CompactionPolicy:
        c = self.compaction
        return CompactionPolicy(c.target_utilization, c.min_compact_bytes, c.max_compact_bytes)


def _typed(old, new, name: str):
    """``new`` as the type of ``old``; text, as the environment gives it, is read as that type."""
    if isinstance(old, bool):
        if isinstance(new, bool):
            return new
        if str(new).lower() in ("true", "1", "yes", "on", "false", "0", "no", "off"):
            return str(new).lower() in ("true", "1", "yes", "on")
        raise ValueError(f"{name}: {new!r} is neither true nor false")
    if isinstance(new, bool) or isinstance(old, int) and isinstance(new, float):
        raise ValueError(f"{name}: {new!r} is not of type {type(old).__name__}")
    try:
        return type(old)(new)
    except (TypeError, ValueError) as error:
        raise ValueError(f"{name}: {new!r} is not of type {type(old).__name__}") from error


def _with(config: Config, section: str, values: Mapping) -> Config:
    if section not in {f.name for f in fields(config)}:
        raise ValueError(f"unknown section {section}")
    part = getattr(config, section)
    if unknown := set(values) - {f.name for f in fields(part)}:
        raise ValueError(f"unknown keys in {section}: {', '.join(sorted(unknown))}")
    return replace(config, **{section: replace(part, **{k: _typed(getattr(part, k), v, f"{section}.{k}") for k, v in values.items()})})


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    """The checked configuration of a TOML file, with ``PALIMPSEST__section__field`` of the environment over it.

    Sections and fields of the environment are taken in either case.  An unknown section
    or key is an error, as is a value of another type.
    """
    out, env = Config(), os.environ if env is None else env
    if path:
        with open(path, "rb") as f:
            for section, values in tomllib.load(f).items():
                if not isinstance(values, dict):
                    raise ValueError(f"{section} is not a section")
                out = _with(out, section, values)
    for name in sorted(n for n in env if n.startswith(PREFIX)):
        section, _, key = name[len(PREFIX) :].lower().partition("__")
        out = _with(out, section, {key: env[name]})
    return out.check()
