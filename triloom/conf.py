"""Settings of an engine."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "spark.triloom."


@dataclass
class Conf:
    #: Drop repeated solutions of each pattern (graphs as sets).
    distinct_preprocessing: bool = False
    #: Rows up to which a side is broadcast when its number was counted.
    in_memory_threshold: int = 100_000
    #: Share of rows that join samples take, and the largest joins (in inputs) that are sampled.
    sample_rate: float = 0.05
    max_sampling_cycles: int = 2
    #: "static" (counts by predicate and fixed shares), "counting" (each pattern is counted), "sampling" (that, and pairs are joined on
    #: samples), "faking" (for tests), or a weighted sum of them.
    cost_calculator: str = "static"
    #: "prune" (keep the cheapest share of the sets of each size) or "exhaustive".
    optimization_strategy: str = "prune"
    static_prune: float = 3.0
    #: Rows of a key in a sample above which it counts as dense.
    sampling_threshold: int = 1000
    #: max - mean of a key's products above which a join is dealt with as skewed; 0 switches that off.
    join_skewness: float = 10_000_000
    hot_keys: int = 1000
    #: Cost of a level of joins, of a tuple read and written, and factor for inputs that fit in memory.
    cost_per_depth: float = 100_000_000
    replicated_threshold: int = 10_000
    cost_read: float = 1
    cost_write: float = 3
    replicated_bonus: float = 0.1
    #: Patterns beyond which plans are grown greedily.
    most_enumerated: int = 8
    optimize: bool = True
    #: Merge patterns of one subject over one table to a single scan.
    stars: bool = True
    #: Unbound shared variables match anything.
    strict_optional: bool = False
    #: Datatype and language tags are part of the terms (the triples must have been loaded with them).
    keep_tags: bool = False
    reset_cache_for_each_query: bool = True
    statistics_file: str = ""

    @classmethod
    def load(cls, path: str | None = None, spark=None, **given) -> Conf:
        """Defaults, then the [triloom] section of an ini file, then the session's spark.triloom.* settings, then what is given by name.

        Names may be written with dots or underscores: sample.rate, sample_rate.
        """
        found: dict[str, str] = {}
        if path and Path(path).exists():
            reader = configparser.ConfigParser()
            text = Path(path).read_text()
            reader.read_string(text if text.lstrip().startswith("[") else "[triloom]\n" + text)
            found |= dict(reader["triloom"]) if "triloom" in reader else {}
        if spark is not None:
            found |= {k.removeprefix(PREFIX): v for k, v in spark.conf.getAll.items() if k.startswith(PREFIX)}
        kinds, out = {f.name: type(f.default) for f in fields(cls)}, {}
        for name, value in ({k.replace(".", "_"): v for k, v in found.items()} | given).items():
            if name not in kinds:
                raise ValueError(f"unknown setting {name!r}")
            kind = kinds[name]
            out[name] = value if not isinstance(value, str) else value.lower() in ("true", "1", "yes") if kind is bool else kind(value)
        return cls(**out)
