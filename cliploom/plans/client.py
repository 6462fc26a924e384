"""The Python API: one method per kind of search, results as ranked DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import list_hash
from .engine import Engine, client_score
from .filters import SearchFilters


class SearchResult:
    """A ranked result; rows stay in Spark until asked for."""

    def __init__(self, rows: DataFrame, filters: SearchFilters):
        self.rows, self.filters = rows, filters

    @property
    def clip_ids(self) -> list[str]:
        return [r.clip_id for r in self.rows.select("clip_id").collect()]

    def head(self, n: int) -> SearchResult:
        return SearchResult(self.rows.limit(n), self.filters)

    def as_dataframe(self) -> DataFrame:
        """clip_id, all scores of the search (bm25 too) and the best one."""
        return self.rows.withColumn("best_score", client_score(self.rows))


class Client:
    def __init__(self, engine: Engine, granted: Sequence[str] | None = None):
        self.engine, self.granted = engine, granted

    def search(self, **filters: Any) -> SearchResult:
        return self._run(SearchFilters.from_kwargs(self.granted, **filters))

    def search_from_url(self, url: str) -> SearchResult:
        return self._run(SearchFilters.from_url(url, self.granted))

    def _run(self, f: SearchFilters) -> SearchResult:
        return SearchResult(self.engine.search(f), f)

    def search_caption(self, text: str, **more: Any) -> SearchResult:
        return self.search(search=text, **more)

    def search_caption_any(self, terms: Sequence[str], **more: Any) -> SearchResult:
        """Captions with any of the terms."""
        return self.search(search=terms[0], caption_extra_queries=list(terms[1:]), **more)

    def search_caption_embed(self, text: str, **more: Any) -> SearchResult:
        return self.search(caption_embed_text=text, **more)

    def search_semantic_text(self, text: str, **more: Any) -> SearchResult:
        return self.search(semantic_text=text, **more)

    def search_clip(self, clip_id: str, **more: Any) -> SearchResult:
        return self.search(semantic_clip=clip_id, **more)

    def search_visual_text(self, text: str, **more: Any) -> SearchResult:
        return self.search(visual_text=text, **more)

    def search_visual_image(self, upload_id: str, **more: Any) -> SearchResult:
        return self.search(visual_image=upload_id, **more)

    def search_trajectory_pattern(self, name: str, **more: Any) -> SearchResult:
        return self.search(trajectory_pattern=name, **more)

    def search_trajectory_shape(self, clip_id: str, start: float | None = None, end: float | None = None, **more: Any) -> SearchResult:
        return self.search(search_trajectory=clip_id, trajectory_start=start, trajectory_end=end, **more)

    def search_classifier(self, run_id: str, expression: str, **more: Any) -> SearchResult:
        return self.search(classifier_run_id=run_id, probability_expression=expression, **more)

    def search_cluster(self, run_id: str, ids: Sequence[int], **more: Any) -> SearchResult:
        return self.search(cluster_run_id=run_id, cluster_ids=list(ids), **more)

    def search_country(self, country: str, **more: Any) -> SearchResult:
        return self.search(search_country=country, **more)

    def search_clip_list(self, digest: str, **more: Any) -> SearchResult:
        return self.search(clip_id_list_hash=digest, **more)

    def search_world_model(self, cls: str, least: int, most: int | None = None, **more: Any) -> SearchResult:
        return self.search(wm_class_name=cls, wm_min_count=least, wm_max_count=most, **more)

    def upload_clip_list(self, clip_ids: Sequence[str]) -> str:
        """Store a list under its hash; the same set again changes nothing, an empty one is an error."""
        if not clip_ids:
            raise ValueError("an empty list")
        digest, c = list_hash(clip_ids), self.engine.catalog
        new = c.clips.sparkSession.createDataFrame([(digest, x) for x in sorted(set(clip_ids))], "hash string, clip_id string")
        c.clip_lists = new if c.clip_lists is None else c.clip_lists.filter(F.col("hash") != digest).unionByName(new)
        self.engine.invalidate(digest)
        return digest
