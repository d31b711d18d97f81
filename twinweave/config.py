"""Typed configuration, checked when it is built.

Each class covers one stage of a matching run; ``MatchingConfig`` ties them
together.  Names of tables are resolved later by ``sources.Catalog``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

# The default token pattern and its Unicode-aware alternative.
ASCII_TOKENS = "[^0-9A-Za-z.]+"
UNICODE_TOKENS = r"[^\p{L}\p{N}.]+"

MISSING_POLICIES = ("wildcard", "null_block", "drop")
METRICS = ("ratio", "levenshtein", "equal")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class PredicateRef:
    """A predicate table by name; the two fields allow an inverted relation."""

    table: str
    from_field: str = "sub"
    to_field: str = "obj"

    def __post_init__(self):
        _require(bool(self.table), "a predicate needs a table name")


@dataclass(frozen=True)
class LevelConfig:
    """One blocking level.  ``max_len=None`` keys on the whole lower-cased value."""

    source: PredicateRef
    target: PredicateRef
    max_len: int | None = 1
    pattern: str = ASCII_TOKENS
    target_max_len: int | None = None
    target_pattern: str | None = None

    def __post_init__(self):
        for n in (self.max_len, self.target_max_len):
            _require(n is None or n >= 1, "max_len must be at least 1")
        _require(bool(self.pattern), "the token pattern must not be empty")


@dataclass(frozen=True)
class AttributeConfig:
    name: str
    source: PredicateRef
    target: PredicateRef
    default: float = 0.0
    ignore: str = ""
    metric: str = "ratio"

    def __post_init__(self):
        _require(self.metric in METRICS, f"metric must be one of {METRICS}")
        _require(0.0 <= self.default <= 1.0, "a default similarity lies in [0, 1]")


@dataclass(frozen=True)
class RelationConfig:
    name: str
    source: PredicateRef
    target: PredicateRef
    default: float = 0.0
    threshold: float = 0.8

    def __post_init__(self):
        _require(0.0 < self.threshold <= 1.0, "threshold lies in (0, 1]")
        _require(0.0 <= self.default <= 1.0, "a default similarity lies in [0, 1]")


@dataclass(frozen=True)
class FusionConfig:
    """One fused field of the matched instances; ``many`` fuses whole value sets."""

    field: str
    source: PredicateRef
    target: PredicateRef
    rule: Callable
    many: bool = False

    def __post_init__(self):
        _require(bool(self.field), "a fused field needs a name")
        _require(callable(self.rule), "a fusion rule joins two columns")


@dataclass(frozen=True)
class FtrlParams:
    l1: float = 0.0
    l2: float = 0.5
    alpha: float = 0.05
    beta: float = 0.5
    max_iter: int = 1000
    eta: float = 0.01
    epochs: int = 20
    clip_loss: bool = True

    def __post_init__(self):
        _require(self.alpha > 0, "alpha must be positive")
        _require(self.l1 >= 0 and self.l2 >= 0 and self.beta >= 0, "negative penalty")
        _require(self.max_iter >= 1 and self.epochs >= 1, "max_iter and epochs start at 1")


@dataclass(frozen=True)
class Thresholds:
    unique: float = 0.4
    candidate: float = 0.5
    train: float = 0.5


@dataclass(frozen=True)
class MatchingConfig:
    """A whole run: two instance lists, levels, features, learner and decision.

    Answers update the model in one exact pass, in one task.  ``answer_shard_rows`` folds
    them in shards of about so many instead and averages, for answers that grow with the tables.
    """

    source_instances: str
    target_instances: str
    block_by: tuple[LevelConfig, ...]
    attributes: tuple[AttributeConfig, ...] = ()
    relations: tuple[RelationConfig, ...] = ()
    partition_by: tuple[LevelConfig, ...] = ()
    missing: str = "wildcard"
    multi: str = "fanout"
    ftrl: FtrlParams = field(default_factory=FtrlParams)
    thresholds: Thresholds = field(default_factory=Thresholds)
    train_size: int = 200
    seed: int = 0
    mode: str = "top1"
    neg_rate: float = 1.0
    fuse: tuple[FusionConfig, ...] = ()
    answer_shard_rows: int | None = None

    def __post_init__(self):
        _require(self.block_by or self.partition_by, "at least one level is needed")
        _require(self.attributes or self.relations, "at least one feature is needed")
        _require(self.missing in MISSING_POLICIES, f"missing must be one of {MISSING_POLICIES}")
        _require(self.multi in ("fanout", "max"), "multi must be 'fanout' or 'max'")
        _require(self.mode in ("top1", "mutual_best", "one_to_one"),
                 "mode must be 'top1', 'mutual_best' or 'one_to_one'")
        _require(self.train_size >= 2, "train_size must be at least 2")
        _require(0.0 <= self.neg_rate <= 1.0, "neg_rate lies in [0, 1]")
        _require(self.answer_shard_rows is None or self.answer_shard_rows >= 1,
                 "answer_shard_rows starts at 1")
        fused = [f.field for f in self.fuse]
        _require(len(fused) == len(set(fused)), "fused fields must be unique")
        names = [f.name for f in (*self.attributes, *self.relations)]
        _require(len(names) == len(set(names)), "feature names must be unique")
        for name in names:
            _require(re.fullmatch(r"\w+", name) is not None, f"bad feature name {name!r}")

    @property
    def dim(self) -> int:
        return len(self.attributes) + len(self.relations)
