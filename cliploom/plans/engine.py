"""A search as one lazy plan: the universe narrowed by stages in a fixed order, then ranked.

Stage order matters only where a stage takes a top-k of what is left; all else commutes and is
Catalyst's to arrange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workdir import workdir
from ..operators import classifiers, clusters, labels, perception, text, trajectory, vector_index, vector_search
from .filters import SearchFilters

#: Score columns by rank priority; negative ones count from the small end.
PRIORITY = (
    ("numeric", 1), ("classifier_score", 1), ("caption_embed_score", 1), ("semantic_text_score", 1), ("semantic_clip_score", 1),
    ("visual_text_score", 1), ("visual_image_score", 1), ("trajectory_score", -1), ("cluster_distance", -1),
)


@dataclass
class Catalog:
    """Tables of one deployment; those that a search doesn't need may be missing."""

    clips: DataFrame
    video_paths: DataFrame
    annotations: DataFrame | None = None
    captions: DataFrame | None = None
    apis: DataFrame | None = None
    video_vectors: DataFrame | None = None
    caption_vectors: DataFrame | None = None
    visual_vectors: DataFrame | None = None
    trajectories: DataFrame | None = None
    perception: DataFrame | None = None
    metrics: DataFrame | None = None
    bev: DataFrame | None = None
    clip_lists: DataFrame | None = None
    assignments: DataFrame | None = None
    classifier_scores: DataFrame | None = None
    #: text -> vector, by space (caption, video, visual); uploads: image id -> vector.
    encoders: dict[str, Callable[[str], Sequence[float]]] = field(default_factory=dict)
    #: Stored vector indexes by space; a space without one is searched exactly.
    indexes: dict[str, vector_index.Index] = field(default_factory=dict)
    #: Folder of a text index that outlives the session; without one, an index goes with the session.
    text_index: str | None = None
    uploads: dict[str, Sequence[float]] = field(default_factory=dict)


class Engine:
    """Runs searches over a catalog; a text index is written once and kept.

    ``k`` limits the hits of vector and shape stages, which come before labels, lists and clusters: a clip that these
    would keep is lost if k others are nearer. None sets no limit, which is exact, and asks no vector index. ``n_probe`` and
    ``refine`` are those of vector indexes. With ``visual_rows``, visual searches pool the nearest so many rows of each query
    to clips, instead of all rows.
    """

    def __init__(self, catalog: Catalog, k: int | None = 8192, most_plans: int = 1000, n_probe: int = 16, refine: int = 8, visual_rows: int | None = None):
        self.n_probe, self.refine, self.visual_rows = n_probe, refine, visual_rows
        self.catalog, self.k, self._index, self.most_plans = catalog, k, None, most_plans
        self._plans: dict[str, DataFrame] = {}

    def universe(self) -> DataFrame:
        return self.catalog.video_paths.select("clip_id")

    def search(self, filters: SearchFilters) -> DataFrame:
        """clip_id, score columns and rank_score, best first. Equal filters share a plan."""
        if (key := filters.key()) not in self._plans:
            if len(self._plans) >= self.most_plans:
                self._plans.pop(next(iter(self._plans)))
            self._plans[key] = self.plan(filters)
        return self._plans[key]

    def plan(self, f: SearchFilters) -> DataFrame:
        r = self.universe()
        for stage in (self._tables, self._perception, self._motion, self._visual, self._captions, self._caption_vectors, self._video_vectors, self._labels, self._list, self._cluster, self._classifier):
            r = stage(r, f)
        return rank(r, f)

    def invalidate(self, *terms: str) -> None:
        """Forget plans whose key has any of the terms."""
        for key in [k for k in self._plans if any(t in k for t in terms)]:
            del self._plans[key]

    def captions_changed(self, changed: DataFrame | None = None) -> None:
        """Forget the text index and all plans; the next caption search opens it again.

        A lasting index gets a new version first: of all captions, or with the documents of the changed clips built again.
        """
        if self.catalog.text_index is not None:
            if changed is None:
                text.save_index(self.catalog.captions, self.catalog.text_index)
            else:
                text.refresh_index(self.catalog.captions, self.catalog.text_index, changed)
        self._index = None
        self._plans.clear()

    def _tables(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if f.with_metrics is not None:
            r = labels.in_list(r, self.catalog.metrics.select("clip_id").distinct(), f.with_metrics)
        return r if f.with_bev is None else labels.in_list(r, self.catalog.bev, f.with_bev)

    def _perception(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if f.wm_class_name and f.wm_min_count is not None:
            r = perception.by_count(r, self.catalog.perception, f.wm_class_name, f.wm_min_count, f.wm_max_count)
        if f.wm_class_name and f.wm_angle_range and f.wm_max_dist is not None and f.wm_min_time is not None:
            r = perception.by_range(r, self.catalog.perception, f.wm_class_name, f.wm_angle_range, f.wm_max_dist, f.wm_min_time)
        return r

    def _motion(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        t = self.catalog.trajectories
        if f.search_trajectory:
            d = trajectory.by_shape(t, f.search_trajectory, self.k, f.trajectory_start, f.trajectory_end, r)
            r = r.join(d.withColumnRenamed("distance", "trajectory_score"), "clip_id")
        if f.search_speed or f.trajectory_pattern:
            r = trajectory.by_motion(r, t, f.search_speed, f.trajectory_pattern)
        elif f.with_ego_data is not None and not f.search_trajectory:
            r = labels.in_list(r, t, f.with_ego_data)
        return r

    def _near(self, r: DataFrame, space: str, vectors: DataFrame, queries: list[Sequence[float]]) -> DataFrame:
        if space == "visual" and self.visual_rows is not None:
            return vector_search.search_rows(vectors, queries, self.visual_rows, r)
        index = self.catalog.indexes.get(space)
        if index is None or self.k is None:
            return vector_search.search_many(vectors, queries, self.k, r)
        asked = r.sparkSession.createDataFrame([(str(i), [float(x) for x in q]) for i, q in enumerate(queries)], "query_id string, vec array<double>")
        return vector_search.top(vector_search.pooled(index.search(asked, self.k, self.n_probe, self.refine, r)), self.k)

    def _vectors(self, r: DataFrame, space: str, vectors: DataFrame, queries: list[Sequence[float]], out: str, cutoff: float | None = None) -> DataFrame:
        s = self._near(r, space, vectors, queries)
        if cutoff is not None:
            s = s.filter(F.col("score") > cutoff)
        return r.join(s.withColumnRenamed("score", out), "clip_id")

    def _encode(self, space: str, main: str, extra: Sequence[str]) -> list[Sequence[float]]:
        return [self.catalog.encoders[space](t) for t in dict.fromkeys([main, *extra])]

    def _visual(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if f.visual_text:
            r = self._vectors(r, "visual", self.catalog.visual_vectors, self._encode("visual", f.visual_text, f.visual_extra), "visual_text_score")
        if f.visual_image:
            q = self.catalog.uploads.get(f.visual_image)
            if q is None:
                return r.filter(F.lit(False)).withColumn("visual_image_score", F.lit(None).cast("double"))
            r = self._vectors(r, "visual", self.catalog.visual_vectors, [q], "visual_image_score")
        return r

    def _captions(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if not f.search and not f.caption_extra_queries:
            return r
        if self._index is None:
            spark = self.catalog.captions.sparkSession
            path = self.catalog.text_index or workdir(spark, "text-index")
            if not text.versions(spark, path):
                text.save_index(self.catalog.captions, path)
            self._index = text.open_index(spark, path)
        index, n_docs, avg_len = self._index
        q = text.parse_any([x for x in [f.search, *f.caption_extra_queries] if x])
        return r.join(text.search(index, n_docs, avg_len, q, f.data_source or None, r, None), "clip_id")

    def _caption_vectors(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if not f.caption_embed_text:
            return r
        return self._vectors(r, "caption", self.catalog.caption_vectors, self._encode("caption", f.caption_embed_text, f.caption_embed_extra), "caption_embed_score")

    def _video_vectors(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        v = self.catalog.video_vectors
        if f.semantic_text:
            r = self._vectors(r, "video", v, self._encode("video", f.semantic_text, f.semantic_extra), "semantic_text_score", vector_search.CUTOFF)
        if f.semantic_clip:
            if "video" in self.catalog.indexes and (q := vector_search.vector_of(v, f.semantic_clip)):
                r = self._vectors(r, "video", v, [q], "semantic_clip_score", vector_search.CUTOFF)
            else:
                s = vector_search.search_clip(v, f.semantic_clip, self.k, r)
                r = r.join(s.withColumnRenamed("score", "semantic_clip_score"), "clip_id")
        return r

    def _labels(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        c, a, p = self.catalog.clips, self.catalog.annotations, f.project_source
        if f.search_clipid:
            r = labels.by_clip(r, f.search_clipid)
        if f.sil_apis:
            r = labels.by_api(r, self.catalog.apis, f.sil_apis)
        if f.search_country:
            r = labels.by_country(r, c, f.search_country)
        elif f.left_hand_driving:
            r = labels.by_left_hand(r, c)
        if f.filter and f.without_ann is None:
            r = labels.by_labels(r, a, f.filter, p, f.filter_mode)
        for n in f.numeric_filter:
            r = labels.by_numeric(r, a, n.key, n.low, n.high, p)
        sources = labels.allowed_sources(f.data_source, f.granted_sources)
        if sources is not None:
            mode = f.data_source_mode if f.data_source else "any"
            r = labels.by_sources(r, c, sources, mode) if sources else r.filter(F.lit(False))
        if f.times is not None:
            r = labels.by_times(r, a, f.times, p)
        if f.label_types:
            r = labels.by_label_types(r, a, f.label_types, p)
        if f.labels_to_exclude:
            r = labels.without_labels(r, a, f.labels_to_exclude, p, f.labels_to_exclude_mode)
        return labels.without_annotations(r, a, p) if f.without_ann else r

    def _list(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if not f.clip_id_list_hash:
            return r
        return r.join(self.catalog.clip_lists.filter(F.col("hash") == f.clip_id_list_hash).select("clip_id"), "clip_id", "left_semi")

    def _cluster(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if not f.cluster_run_id or not f.cluster_ids:
            return r
        return clusters.by_cluster(r, self.catalog.assignments, f.cluster_run_id, f.cluster_ids, f.cluster_distance_min, f.cluster_distance_max)

    def _classifier(self, r: DataFrame, f: SearchFilters) -> DataFrame:
        if not f.classifier_run_id or not f.probability_expression:
            return r
        return classifiers.by_probability(r, self.catalog.classifier_scores, f.classifier_run_id, f.probability_expression)


def _numeric_score(f: SearchFilters) -> Column:
    """The last numeric filter's value; ascending order counts from the small end."""
    n = f.numeric_filter[-1]
    v = F.col("numeric_scores")[n.key]
    return -v if n.order == "asc" else v


def active_scores(r: DataFrame, f: SearchFilters) -> list[Column]:
    """The scores that a search has, each so that higher is better, by priority."""
    out = []
    for name, sign in PRIORITY:
        if name == "numeric":
            if f.numeric_filter:
                out.append(_numeric_score(f))
        elif name in r.columns:
            out.append(sign * F.col(name))
    return out


def numbered(r: DataFrame, by: str, out: str, key: str = "clip_id") -> DataFrame:
    """r plus each row's place by descending ``by`` (nulls last) and key, from 1.

    Rows are sorted in ranges; a range's places begin after the rows of the ranges before it, whose counts are all that
    the driver gets. The sorted rows are written, so that counts and places are of the same ranges.
    """
    spark, path = r.sparkSession, workdir(r.sparkSession, "numbered")
    r.repartitionByRange(F.desc_nulls_last(by), key).sortWithinPartitions(F.desc_nulls_last(by), key).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    r = spark.read.parquet(path)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for x in r.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per range
        before += [F.lit(x.part), F.lit(total)]
        total += x.n
    begin = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return r.withColumn(out, begin + place + 1).drop("_at")


def rank(r: DataFrame, f: SearchFilters) -> DataFrame:
    """rank_score, and rows in its order: by priority the first score there is, or by reciprocal ranks over all.

    Without scores, caption matches go by BM25, other clips by id.
    """
    scores = active_scores(r, f)
    if f.rank_mode == "rrf" and scores:
        for k, s in enumerate(scores):
            r = numbered(r.withColumn(f"_s{k}", s), f"_s{k}", f"_n{k}")
            r = r.withColumn(f"_r{k}", F.when(F.col(f"_s{k}").isNotNull(), 1 / (60 + F.col(f"_n{k}"))).otherwise(0.0))
        total = sum((F.col(f"_r{k}") for k in range(len(scores))), F.lit(0.0))
        r = r.withColumn("rank_score", total).drop(*[f"_{x}{k}" for x in "nsr" for k in range(len(scores))])
    elif scores:
        r = r.withColumn("rank_score", F.coalesce(*scores, F.lit(0.0)).cast("double"))
    else:
        r = r.withColumn("rank_score", F.col("bm25") if "bm25" in r.columns else F.lit(0.0))
    return r.orderBy(F.desc("rank_score"), "clip_id")


def page(result: DataFrame, n: int, number: int) -> DataFrame:
    """A page of a ranked result: n from 1 to 20, numbers from 0 up to the last page."""
    n = max(1, min(20, n))
    total = result.count()
    number = max(0, min(number, max(0, -(-total // n) - 1)))
    return result.offset(number * n).limit(n)


def hydrate(page_: DataFrame, catalog: Catalog, projects: list[str]) -> DataFrame:
    """A page's clips with metadata, annotations and captions; only the page's rows meet the big tables."""
    from ..operators.joins import with_annotations

    ids = page_.select("clip_id")
    keep = lambda d: d.join(ids, "clip_id", "left_semi")
    out = page_.join(keep(catalog.clips), "clip_id", "left")
    out = with_annotations(out, keep(catalog.annotations), projects)
    if catalog.captions is not None:
        c = text.captions_by_model(keep(catalog.captions)).groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("model_name", "captions"))).alias("captions"))
        out = out.join(c, "clip_id", "left")
    return out.orderBy(F.desc("rank_score"), "clip_id")


def best_score() -> list[str]:
    """Priority of scores on the client side."""
    return ["rrf", "classifier_score", "semantic_text_score", "semantic_clip_score", "caption_embed_score", "visual_image_score", "visual_text_score", "trajectory_score", "cluster_distance"]


def client_score(r: DataFrame) -> Column:
    """The first finite score of a row; distances as 1 / (1 + d)."""
    cols = []
    for c in best_score():
        if c in r.columns:
            v = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
            cols.append(1 / (1 + v) if c in ("trajectory_score", "cluster_distance") else v)
    return F.coalesce(*cols, F.lit(0.0))
