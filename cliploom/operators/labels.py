"""Label, metadata and numeric filters, and the label summaries.

Annotations with a value are numeric and count for no label filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sets

#: Countries that drive on the left, as far as the data set has them (fixed values).
LEFT_HAND_COUNTRIES = ("MT", "GB", "JP")


def source_tokens(col: str = "data_source") -> Column:
    """A comma list as an array of trimmed tokens."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_source(token: Column | str, col: str = "data_source") -> Column:
    """Exact membership of one token in a comma list."""
    return F.array_contains(source_tokens(col), token)


def labels_only(annotations: DataFrame, projects: Sequence[str] | None = None) -> DataFrame:
    a = annotations.filter("value is null")
    return a if projects is None else a.filter(F.col("project").isin(list(projects)))


def by_clip(result: DataFrame, clip_id: str) -> DataFrame:
    return result.filter(F.col("clip_id") == clip_id)


def by_api(result: DataFrame, apis: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Clips that carry any of the tags; apis is (clip_id, apis array)."""
    hit = apis.filter(F.arrays_overlap("apis", F.array(*map(F.lit, tags)))).select("clip_id")
    return result.join(hit, "clip_id", "left_semi")


def by_country(result: DataFrame, clips: DataFrame, country: str) -> DataFrame:
    """A clip without a country has the empty one."""
    return result.join(clips.filter(F.coalesce("country", F.lit("")) == country), "clip_id", "left_semi")


def by_left_hand(result: DataFrame, clips: DataFrame, countries: Sequence[str] = LEFT_HAND_COUNTRIES) -> DataFrame:
    return result.join(clips.filter(F.col("country").isin(list(countries))), "clip_id", "left_semi")


def _label_sets(annotations: DataFrame, labels: Sequence[str], projects: Sequence[str]) -> DataFrame:
    a = labels_only(annotations, projects).filter(F.col("key").isin(list(labels)))
    return a.select(F.col("key").alias("set_id"), "clip_id")


def by_labels(result: DataFrame, annotations: DataFrame, labels: Sequence[str], projects: Sequence[str], mode: str = "any") -> DataFrame:
    """Clips with any label, or with each label in at least one of the projects."""
    s = _label_sets(annotations, labels, projects)
    return sets.project_any(result, s) if mode == "any" else sets.project_all(result, s, len(set(labels)))


def without_labels(result: DataFrame, annotations: DataFrame, labels: Sequence[str], projects: Sequence[str], mode: str = "any") -> DataFrame:
    s = _label_sets(annotations, labels, projects)
    return sets.exclude_any(result, s) if mode == "any" else sets.exclude_all(result, s, len(set(labels)))


def by_numeric(result: DataFrame, annotations: DataFrame, key: str, low: float, high: float, projects: Sequence[str] | None = None) -> DataFrame:
    """Clips with a value of ``key`` in [low, high]; adds it to the map ``numeric_scores``. Several values: the largest."""
    a = annotations.filter((F.col("key") == key) & F.col("value").between(low, high))
    if projects is not None:
        a = a.filter(F.col("project").isin(list(projects)))
    v = a.groupBy("clip_id").agg(F.max("value").alias("_v"))
    new = F.create_map(F.lit(key), F.col("_v"))
    out = result.join(v, "clip_id")
    if "numeric_scores" in result.columns:
        keep = F.map_filter(F.coalesce("numeric_scores", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), lambda k, _: k != key)
        new = F.map_concat(keep, new)
    return out.withColumn("numeric_scores", new).drop("_v")


def by_sources(result: DataFrame, clips: DataFrame, sources: Sequence[str], mode: str = "any") -> DataFrame:
    want, have = F.array(*map(F.lit, sources)).cast("array<string>"), source_tokens()
    hit = F.arrays_overlap(have, want) if mode == "any" else F.size(F.array_except(want, have)) == 0
    return result.join(clips.filter(hit), "clip_id", "left_semi")


def allowed_sources(requested: Sequence[str], granted: Sequence[str] | None) -> list[str] | None:
    """Row-level security: requested sources within the granted ones. None: no restriction at all."""
    if granted is None:
        return list(requested) or None
    return [s for s in requested if s in set(granted)] if requested else list(granted)


def by_times(result: DataFrame, annotations: DataFrame, timed: bool, projects: Sequence[str] | None = None) -> DataFrame:
    """timed: clips with a timed annotation; else clips with annotations, none of them timed."""
    a = annotations if projects is None else annotations.filter(F.col("project").isin(list(projects)))
    n = a.groupBy("clip_id").agg(F.count_if(F.col("start_time") != -1).alias("n"))
    return result.join(n.filter("n > 0" if timed else "n = 0"), "clip_id", "left_semi")


def by_label_types(result: DataFrame, annotations: DataFrame, types: Sequence[str], projects: Sequence[str] | None = None) -> DataFrame:
    return result.join(labels_only(annotations, projects).filter(F.col("label_type").isin(list(types))), "clip_id", "left_semi")


def without_annotations(result: DataFrame, annotations: DataFrame, projects: Sequence[str] | None = None) -> DataFrame:
    return result.join(labels_only(annotations, projects), "clip_id", "left_anti")


def unannotated(clips: DataFrame, annotations: DataFrame) -> DataFrame:
    """Clips without any annotation at all, numeric ones included."""
    return clips.join(annotations, "clip_id", "left_anti")


def in_list(result: DataFrame, listed: DataFrame, present: bool = True) -> DataFrame:
    """Clips that a table has (metrics, scenes, ego data), or has not."""
    return result.join(listed.select("clip_id"), "clip_id", "left_semi" if present else "left_anti")


def ground_truth(annotations: DataFrame, project: str, min_count: int, deny: str) -> DataFrame:
    """(key, clip_id) of the labels with enough clips whose name doesn't match the regular expression."""
    a = labels_only(annotations, [project]).filter(~F.col("key").rlike(deny)).select("key", "clip_id").distinct()
    enough = a.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("key")
    return a.join(enough, "key", "left_semi")


def slices(clips: DataFrame, annotations: DataFrame, corpus: DataFrame, source_like: Sequence[str], key_like: Sequence[str]) -> DataFrame:
    """(slice, clip_id): source patterns, label patterns and each source with each label pattern, within the corpus."""
    inside = clips.join(corpus.select("clip_id"), "clip_id", "left_semi")
    s = inside.select("clip_id", F.explode(F.array(*[F.when(F.col("data_source").like(f"%{p}%"), F.lit(p)) for p in source_like])).alias("src")).filter("src is not null")
    k = labels_only(annotations).select("clip_id", F.explode(F.array(*[F.when(F.col("key").like(p), F.lit(p)) for p in key_like])).alias("lab")).filter("lab is not null").distinct()
    k = k.join(corpus.select("clip_id"), "clip_id", "left_semi")
    both = s.join(k, "clip_id").select(F.concat_ws(" & ", "src", "lab").alias("slice"), "clip_id")
    return s.select(F.col("src").alias("slice"), "clip_id").unionByName(k.select(F.col("lab").alias("slice"), "clip_id")).unionByName(both)


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("label_type") == "manual").alias("n_manual"),
        F.count_if(F.col("label_type") == "autolabel").alias("n_autolabel"),
        F.count_if(F.col("start_time") != -1).alias("n_timed"),
    ]


def label_state(annotations: DataFrame, *by: str) -> DataFrame:
    """Manual, autolabel and timed counts by (project, key) or by key."""
    return annotations.groupBy(*(by or ("project", "key"))).agg(*_counts())


def label_totals(annotations: DataFrame, projects: Sequence[str]) -> DataFrame:
    a = annotations.filter(F.col("project").isin(list(projects)))
    m, n = F.count_if(F.col("label_type") == "manual"), F.count_if(F.col("label_type") == "autolabel")
    return a.agg(m.alias("n_manual"), n.alias("n_autolabel"), (m + n).alias("n_both"))


def option_set(annotations: DataFrame, projects: Sequence[str], label_type: str | None = None) -> DataFrame:
    """key, n: labels that occur, with their counts."""
    a = annotations.filter(F.col("project").isin(list(projects)))
    kinds = ["manual", "autolabel"] if label_type is None else [label_type]
    return a.groupBy("key").agg(F.count_if(F.col("label_type").isin(kinds)).alias("n")).filter("n > 0")


def options(annotations: DataFrame, clips: DataFrame) -> DataFrame:
    """kind, name: the distinct projects, labels, numeric keys and data sources."""
    a = annotations
    kinds = [
        a.select(F.lit("project").alias("kind"), F.col("project").alias("name")),
        a.filter("value is null").select(F.lit("label").alias("kind"), F.col("key").alias("name")),
        a.filter("value is not null").select(F.lit("metric").alias("kind"), F.col("key").alias("name")),
        clips.select(F.lit("data_source").alias("kind"), F.explode(source_tokens()).alias("name")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()


def multiplicity(annotations: DataFrame) -> DataFrame:
    return labels_only(annotations).groupBy("project", "key", "clip_id").agg(F.count("*").alias("n"))


def source_counts(clips: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent data sources, ties by name."""
    n = clips.select(F.explode(source_tokens()).alias("data_source")).groupBy("data_source").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "data_source").limit(top)


def dataset_metadata(names: DataFrame, datasets: DataFrame) -> DataFrame:
    """name, category, license, with defaults for unknown data sets."""
    d = names.join(datasets, "name", "left")
    return d.select("name", F.coalesce("category", F.lit("Other/unknown")).alias("category"), F.coalesce("license", F.lit("Other/unknown")).alias("license"))
