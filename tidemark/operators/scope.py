"""Predicates that admit markets, tokens and events."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import col, json_list_guard

BIG_VOLUME = 100_000.0


@dataclass(frozen=True)
class Scope:
    """Slugs, beginnings of slugs and market ids that a scope lists, besides its registry."""

    slugs: Sequence[str] = ()
    prefixes: Sequence[str] = ()
    market_ids: Sequence[str] = ()
    tags: Sequence[str] = ()
    fold_case: bool = True


def resolve_scope(*layers: Mapping[str, Sequence[str] | str | None]) -> Scope:
    """A scope from layers of settings, the first that has a setting deciding: overrides, environment, seed, defaults.

    Settings can be lists or comma-separated text; slugs must be lower-case words joined by hyphens.
    """
    chosen: dict[str, tuple[str, ...]] = {}
    for name in ("slugs", "prefixes", "market_ids", "tags"):
        value = next((layer[name] for layer in layers if layer.get(name)), ())
        parts = value.split(",") if isinstance(value, str) else value
        chosen[name] = tuple(dict.fromkeys(p.strip() for p in parts if p.strip()))
    bad = [s for s in (*chosen["slugs"], *chosen["prefixes"]) if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*-?", s)]
    if bad:
        raise ValueError(f"not slugs: {bad}")
    return Scope(**chosen)


def scope_hash(scope: Scope) -> str:
    """16 hexadecimal digits that change if what a scope lists does, whatever the order."""
    listed = {k: sorted(v) if isinstance(v, (list, tuple)) else v for k, v in asdict(scope).items()}
    return hashlib.sha256(json.dumps(listed, sort_keys=True).encode()).hexdigest()[:16]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def slug_in_scope(slug: Column | str, scope: Scope) -> Column:
    """Whether a slug is listed or starts as listed; null slugs are not."""
    s = F.coalesce(F.lower(col(slug)) if scope.fold_case else col(slug), F.lit(""))
    fold = (lambda x: x.lower()) if scope.fold_case else (lambda x: x)
    listed = [s.isin([fold(x) for x in scope.slugs])] if scope.slugs else []
    return _any([*listed, *(s.startswith(fold(p)) for p in scope.prefixes)])


def with_scope(markets: DataFrame, registry: DataFrame, scope: Scope, name: str = "in_scope") -> DataFrame:
    """``markets`` with a flag: in the registry, or in scope by slug or id. Never null."""
    keys = registry.select("market_id").distinct().withColumn("_registered", F.lit(True))
    ids = F.col("market_id").isin(list(scope.market_ids)) if scope.market_ids else F.lit(False)
    flag = F.coalesce(F.col("_registered"), F.lit(False)) | slug_in_scope("event_slug", scope) | F.coalesce(ids, F.lit(False))
    return markets.join(keys, "market_id", "left").withColumn(name, flag).drop("_registered")


def volume_band(volume: Column | str, least: float | None = None, below: float | None = None) -> Column:
    """Whether a volume, null as 0, is in [least, below)."""
    if (least or 0) < 0 or (below or 0) < 0:
        raise ValueError("a negative volume")
    v = F.coalesce(col(volume), F.lit(0.0))
    parts = [F.lit(True)] + [v >= least] * (least is not None) + [v < below] * (below is not None)
    return reduce(lambda a, b: a & b, parts)


def not_ended(end: Column | str, now: datetime, grace_days: int) -> Column:
    """Whether a market is open, or ended at most so many days ago; without an end it is open."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(grace_days))
    return F.coalesce(col(end) >= limit, F.lit(True))


def token_due(now: datetime, created_from: datetime | None = None) -> Column:
    """Whether a token of a market joined with its ledger and skips is to be synced.

    Columns: ``reason`` (of a skip), ``is_closed``, ``fully_checked``, ``next_check_at``, ``created_at``, ``clob_token_ids``.
    """
    done = F.coalesce(F.col("is_closed") & F.col("fully_checked"), F.lit(False))
    waits = F.coalesce(F.col("next_check_at") > F.lit(now).cast("timestamp_ntz"), F.lit(False))
    due = F.col("reason").isNull() & ~done & ~waits & json_list_guard("clob_token_ids")
    if created_from is not None:
        due &= F.coalesce(F.col("created_at") >= F.lit(created_from).cast("timestamp_ntz"), F.lit(False))
    return due


def valid_observation(epoch: Column | str = "odds_timestamp_epoch", price: Column | str = "price") -> Column:
    """Whether an observation has a time after 1970 and a price in [0, 1]; NaN is none."""
    return F.coalesce((col(epoch) > 0) & (col(price) >= 0) & (col(price) <= 1), F.lit(False))


def event_in_scope(slug: Column | str, tags: Column | str, scope: Scope) -> Column:
    """Whether an event is in scope by slug or by a tag."""
    tagged = F.arrays_overlap(col(tags), F.array(*map(F.lit, scope.tags))) if scope.tags else F.lit(False)
    return slug_in_scope(slug, scope) | F.coalesce(tagged, F.lit(False))


def crawl_allowed(tag: Column | str, always: Sequence[str], denied: Sequence[str], keywords: Sequence[str], gate: bool = True) -> Column:
    """Whether a tag is followed, without regard to case and blanks at its ends: always if it is null or listed, never if
    it is empty or denied, else if it has a keyword or the gate is off."""
    t = F.lower(F.trim(col(tag)))
    clean = lambda xs: [y for x in xs if (y := x.strip().lower())]
    has = _any([t.contains(k) for k in clean(keywords)]) if gate else F.lit(True)
    listed = t.isin(clean(always)) if clean(always) else F.lit(False)
    banned = t.isin(clean(denied)) if clean(denied) else F.lit(False)
    return t.isNull() | ((t != "") & (listed | (~banned & has)))


def numeric_id(market_id: Column | str) -> Column:
    """Whether an id is a whole number above 0."""
    return F.coalesce(col(market_id).try_cast("bigint") > 0, F.lit(False))


def lacking(markets: DataFrame, field: str) -> DataFrame:
    """Ids, in the order of their numbers, of markets of numeric ids whose text ``field`` is null or empty."""
    some = markets.filter((F.coalesce(F.col(field), F.lit("")) == "") & numeric_id("market_id"))
    return some.select("market_id").orderBy(F.col("market_id").cast("bigint"), "market_id")


@dataclass(frozen=True)
class Discovery:
    """What the ledger knows of the last discovery: whether it saw everything, and the hash of its scope."""

    fully_checked: bool = False
    scope_hash: str | None = None

    def after(self, scope: Scope, whole: bool, truncated: bool) -> Discovery:
        """The ledger after a discovery: a whole one that wasn't cut short has checked all; another scope or a cut takes
        that back."""
        new = scope_hash(scope)
        if whole and not truncated:
            return Discovery(True, new)
        if self.scope_hash and self.scope_hash != new:
            return Discovery(False, new)
        if self.fully_checked and truncated:
            return Discovery(False, new)
        return self
