"""Scalar functions as Columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inflection endings and what takes their place, longest first (fixed values).
SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alphanumeric(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", ""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def clean_caption(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"[#*\-0-9]+", " "), r"[^\p{L}\p{N}_\s]", " "))


def stem(c: Column) -> Column:
    """Common plural and verb endings cut, if more than two characters stay."""
    out = F.when(F.lit(False), c)
    for end, put in SUFFIXES:
        out = out.when((F.length(c) > len(end) + 2) & c.endswith(end), F.concat(c.substr(F.lit(1), F.length(c) - len(end)), F.lit(put)))
    return out.otherwise(c)


def canonical_ngram(c: Column) -> Column:
    """Sorted stems: equal for n-grams that differ in order or ending only."""
    return F.array_join(F.array_sort(F.transform(F.split(c, " "), stem)), " ")


def token_jaccard(a: Column, b: Column) -> Column:
    t = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    union = F.size(F.array_union(t(a), t(b)))
    return F.when(union > 0, F.size(F.array_intersect(t(a), t(b))) / union).otherwise(0.0)


def path_without_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def first_segment(c: Column) -> Column:
    """/a of /a/b; a path that doesn't start with / stays."""
    return F.when(c.startswith("/"), F.concat(F.lit("/"), F.coalesce(F.get(F.split(c, "/"), F.lit(1)), F.lit("")))).otherwise(c)


def query_value(url: Column, key: str) -> Column:
    """The first value of a query parameter, decoded; null without one."""
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit("")))


def clip_id_parts(c: Column) -> Column:
    """Struct base, start, end of <base>_<start>_<end>, where base has at least 36 characters; else the id alone."""
    m = lambda k: F.regexp_extract(c, r"^(.{36,})_([^_]*)_([^_]*)$", k)
    hit = m(1) != ""
    return F.struct(F.when(hit, m(1)).otherwise(c).alias("base"), F.when(hit, m(2)).alias("start"), F.when(hit, m(3)).alias("end"))


def clip_id_of(video: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s__%s_%d-%d", video, video, start.cast("long"), end.cast("long"))


def keywords(c: Column) -> Column:
    """Comma or line separated keywords: cleaned, lower-cased, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(c), r"[,;\n]"), lambda w: squeeze(F.regexp_replace(w, r"[^\p{L}\p{N} -]", ""))), lambda w: w != ""))


def list_hash(clip_ids: Iterable[str]) -> str:
    """16 hex digits that depend on the set of ids only."""
    return hashlib.blake2b("\n".join(sorted(set(clip_ids))).encode(), digest_size=8).hexdigest()


def hms_seconds(c: Column) -> Column:
    """HH:MM:SS (or MM:SS) to seconds; what doesn't parse is 0."""
    p = F.transform(F.reverse(F.split(c, ":")), lambda x: x.try_cast("long"))
    total = F.aggregate(F.transform(p, lambda x, i: x * F.pow(F.lit(60), i).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.coalesce(total, F.lit(0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log_odds(p: Column, eps: float = 1e-9) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def harmonic_mean(*cols: Column) -> Column:
    """0 if any value isn't positive."""
    total = cols[0] * 0.0
    good = F.lit(True)
    for c in cols:
        total, good = total + F.try_divide(F.lit(1.0), c), good & (c > 0)
    return F.when(good, len(cols) / total).otherwise(0.0)


def quaternion_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def box_corners(x: Column, y: Column, length: Column, width: Column, yaw: Column) -> Column:
    """Corners of a turned box as [x0, y0, ... x3, y3]."""
    out = []
    for a, b in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5)):
        dx, dy = length * a, width * b
        out += [x + dx * F.cos(yaw) - dy * F.sin(yaw), y + dx * F.sin(yaw) + dy * F.cos(yaw)]
    return F.array(*out)


def to_frame(x: Column, y: Column, ego_x: Column, ego_y: Column, ego_yaw: Column) -> tuple[Column, Column]:
    """World coordinates in the ego frame."""
    dx, dy = x - ego_x, y - ego_y
    return dx * F.cos(ego_yaw) + dy * F.sin(ego_yaw), -dx * F.sin(ego_yaw) + dy * F.cos(ego_yaw)


def frame_axes(kind: Column, x: Column, y: Column, z: Column) -> Column:
    """Axis conventions of a recording: forward-left-up turns y; camera axes become (z, x, -y)."""
    camera = F.struct(z.alias("x"), x.alias("y"), (-y).alias("z"))
    flu = F.struct(x.alias("x"), (-y).alias("y"), z.alias("z"))
    return F.when(kind == "camera", camera).when(kind == "flu", flu).otherwise(F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def sampled_frames(total: Column, n: int) -> Column:
    """n frame numbers spread evenly over a clip, ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / max(1, n - 1)).cast("int"))


def every_nth(c: Column, n: int) -> Column:
    return F.filter(c, lambda _, i: i % n == 0)


def expanded_box(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float, factor: float = 1.1) -> Column:
    """A box grown about its centre and cut to the image."""
    cx, cy, hw, hh = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) * factor / 2, (y1 - y0) * factor / 2
    return F.array(clamp(cx - hw, 0, width), clamp(cy - hh, 0, height), clamp(cx + hw, 0, width), clamp(cy + hh, 0, height))


def vote_code(winner: Column, confidence: Column) -> Column:
    """Winner and confidence on a five-point scale: a, a_slightly, tie, b_slightly, b."""
    sure = F.lower(F.coalesce(confidence, F.lit("high"))) == "high"
    return F.when(winner == "a", F.when(sure, "a").otherwise("a_slightly")).when(winner == "b", F.when(sure, "b").otherwise("b_slightly")).otherwise("tie")


def llm_json(c: Column) -> Column:
    """The outermost JSON object of a model's answer, without a reasoning block and fences; {} if none parses."""
    body = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    found = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found).otherwise("{}")


def json_number(c: Column) -> Column:
    """Infinities as strings, for JSON output; NaN stays."""
    return F.when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(c.cast("string"))
