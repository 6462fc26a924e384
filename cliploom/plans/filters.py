"""The query object: a flat bag of optional filters, from keyword arguments, URL queries or URLs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any
from urllib.parse import parse_qs, quote, urlsplit

LIST, COMMA = "||", ","
DEFAULT_PROJECT = "default"


@dataclass
class NumericFilter:
    key: str
    low: float
    high: float
    order: str = "desc"


@dataclass
class SearchFilters:
    """Filters of one search. None or an empty list: not asked for."""

    search_clipid: str | None = None
    sil_apis: list[str] = field(default_factory=list)
    search_country: str | None = None
    left_hand_driving: bool = False
    filter: list[str] = field(default_factory=list)
    filter_mode: str = "any"
    project_source: list[str] = field(default_factory=lambda: [DEFAULT_PROJECT])
    numeric_filter: list[NumericFilter] = field(default_factory=list)
    data_source: list[str] = field(default_factory=list)
    data_source_mode: str = "any"
    times: bool | None = None
    label_types: list[str] = field(default_factory=list)
    labels_to_exclude: list[str] = field(default_factory=list)
    labels_to_exclude_mode: str = "any"
    without_ann: bool | None = None
    with_metrics: bool | None = None
    with_bev: bool | None = None
    wm_class_name: str | None = None
    wm_min_count: int | None = None
    wm_max_count: int | None = None
    wm_angle_range: list[str] = field(default_factory=list)
    wm_max_dist: float | None = None
    wm_min_time: float | None = None
    search_speed: str | None = None
    trajectory_pattern: str | None = None
    search_trajectory: str | None = None
    trajectory_start: float | None = None
    trajectory_end: float | None = None
    with_ego_data: bool | None = None
    search: str | None = None
    caption_extra_queries: list[str] = field(default_factory=list)
    caption_embed_text: str | None = None
    caption_embed_extra: list[str] = field(default_factory=list)
    semantic_text: str | None = None
    semantic_extra: list[str] = field(default_factory=list)
    semantic_clip: str | None = None
    visual_text: str | None = None
    visual_extra: list[str] = field(default_factory=list)
    visual_image: str | None = None
    clip_id_list_hash: str | None = None
    cluster_run_id: str | None = None
    cluster_ids: list[int] = field(default_factory=list)
    cluster_distance_min: float | None = None
    cluster_distance_max: float | None = None
    classifier_run_id: str | None = None
    probability_expression: str | None = None
    rank_mode: str = "priority"
    granted_sources: list[str] | None = None

    @classmethod
    def from_query(cls, query: Mapping[str, Sequence[str]], granted: Sequence[str] | None = None) -> SearchFilters:
        """From URL-style values; lists are joined by ||, numbers by commas; what doesn't parse is left out."""
        kinds, out = {f.name: str(f.type) for f in fields(cls)}, cls(granted_sources=None if granted is None else list(granted))
        for name, values in query.items():
            value = LIST.join(str(v) for v in values)
            if name not in kinds or name == "granted_sources" or not value.strip():
                continue
            kind = kinds[name]
            if name == "numeric_filter":
                out.numeric_filter = [n for p in value.split(LIST) if (n := _numeric(p))]
            elif kind == "list[int]":
                out.cluster_ids = [int(x) for x in value.replace(LIST, COMMA).split(COMMA) if x.strip().lstrip("-").isdigit()]
            elif name == "wm_angle_range":
                out.wm_angle_range = [x.strip() for x in value.replace(LIST, COMMA).split(COMMA) if x.strip()]
            elif kind.startswith("list"):
                setattr(out, name, [x for x in value.split(LIST) if x])
            elif kind.startswith("bool"):
                setattr(out, name, value == "true")
            elif kind.startswith(("int", "float")):
                try:
                    setattr(out, name, (int if kind.startswith("int") else float)(value))
                except ValueError:
                    continue
            else:
                setattr(out, name, value)
        return out

    @classmethod
    def from_url(cls, url: str, granted: Sequence[str] | None = None) -> SearchFilters:
        """From a URL, its query part, or its fragment."""
        parts = urlsplit(url)
        return cls.from_query(parse_qs(parts.query or parts.fragment.lstrip("?") or url.lstrip("?#")), granted)

    @classmethod
    def from_kwargs(cls, granted: Sequence[str] | None = None, **kwargs: Any) -> SearchFilters:
        return cls.from_query(to_query(kwargs), granted)

    def key(self) -> str:
        """A canonical string: equal filters, in any order of their values, give equal keys."""
        parts = []
        for f in sorted(fields(self), key=lambda f: f.name):
            v = getattr(self, f.name)
            if v != f.default and v not in (None, [], ""):
                if isinstance(v, list):
                    v = LIST.join(sorted(COMMA.join(map(str, (n.key, n.low, n.high, n.order))) if isinstance(n, NumericFilter) else str(n) for n in v))
                parts.append(f"{f.name}={quote(str(v))}")
        return "&".join(parts)

    def __hash__(self) -> int:
        return hash(self.key())

    def ranked(self) -> bool:
        """Does any filter give scores to rank by?"""
        return bool(
            self.numeric_filter or self.search_trajectory or self.caption_embed_text or self.semantic_text or self.semantic_clip or self.visual_text
            or self.visual_image or (self.cluster_run_id and self.cluster_ids) or (self.classifier_run_id and self.probability_expression)
        )

    def has_prior_filters(self, name: str) -> bool:
        """Is a ranked filter other than ``name`` active?"""
        from dataclasses import replace

        return replace(self, **{name: SearchFilters.__dataclass_fields__[name].default}).ranked()


def _numeric(part: str) -> NumericFilter | None:
    bits = part.split(COMMA)
    if len(bits) != 4:
        return None
    try:
        return NumericFilter(bits[0], float(bits[1] or "-inf"), float(bits[2] or "inf"), bits[3] or "desc")
    except ValueError:
        return None


def to_query(kwargs: Mapping[str, Any]) -> dict[str, list[str]]:
    """Keyword arguments as URL-style values: None dropped, booleans as true and false, lists joined by ||."""
    text = lambda v: "true" if v is True else "false" if v is False else COMMA.join(map(str, (v.key, v.low, v.high, v.order))) if isinstance(v, NumericFilter) else str(v)
    return {k: [LIST.join(map(text, v)) if isinstance(v, (list, tuple)) else text(v)] for k, v in kwargs.items() if v is not None}
