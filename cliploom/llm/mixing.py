"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. What is wanted of each cell starts at the same
share of its tokens and is raked: scaled to the source, language and topic targets in turn, again and
again. As no document can be taken twice, a cell counts in the sums with its own tokens at most; those
that are beyond that are full, and the others make up for them. A document stays with the wanted part
of its cell as probability. The draw is a hash of the document, so a rerun draws the same.

Targets are shares: by default each margin's own shares raised to a power below one and normalised,
which lifts small groups towards equal weight. A group that holds less than its target is wanted
whole, and what it lacks goes to the margin's other groups by their shares, so every margin can be met by
itself; ``margins`` tells what was wanted, what can be had, and what is expected of each group. Documents are
summed up to cells in a shuffle; the cells, as many as there are combinations of keys, are raked in one task.

Defined results: null languages and sources are groups of their own; null, empty and word-free
texts have no tokens, probability 0, and are not drawn; rows that share a doc_id and a token count
are drawn together; a null doc_id is drawn like any other; an empty table gives no rows; ``keep``
leaves other columns as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, null_key

DIMENSIONS = ("source_key", "lang_key", "topic")


#: A cell this near to its tokens is full; so rounding doesn't decide it.
FULL = 1 - 1e-9


@dataclass(frozen=True)
class Mix:
    """Power of each margin's shares, share of all tokens to keep (0 to 1), rounds of raking."""

    powers: tuple[float, float, float] = (0.5, 0.7, 0.7)
    share: float = 0.6
    rounds: int = 12
    seed: str = "mix-1"


def n_tokens(text: Column) -> Column:
    """Words between white space, as the mixing weight of a document."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by rule from a text's surface: table, question, numeric, listing or prose."""
    size = F.length(text)
    chars = lambda c: size - F.length(F.replace(text, F.lit(c), F.lit("")))
    digits = size - F.length(F.regexp_replace(text, "[0-9]+", ""))
    return (
        F.when(chars("|") >= 3, "table").when(50 * digits > size, "numeric").when(F.contains(text, F.lit("?")), "question")
        .when(chars("\n") * 100 > size, "listing").otherwise("prose")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """docs plus the cell keys and tokens."""
    text = F.col("text")
    return docs.withColumns({"source_key": null_key("source"), "lang_key": null_key("lang"), "topic": F.coalesce(topic_of(text), F.lit("prose")), "tokens": n_tokens(text)})


def targets(cells: DataFrame, dimension: str, power: float, mix: Mix) -> DataFrame:
    """dimension, t_dimension: tokens to keep of each group, no more than it holds, the kept share in all.

    Shares are given out at one level to all, save for groups that hold less. With groups by the level at which they
    are used up, the level is the largest that any of them finds when those before it are used up.
    """
    groups = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("a"))
    groups = groups.withColumns({"s": F.pow("a", F.lit(power)), "one": F.lit(1)})
    order = Window.partitionBy("one").orderBy(F.col("a") / F.col("s"), dimension)
    before = F.coalesce(F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("s").over(order.rowsBetween(0, Window.unboundedFollowing))
    found = (F.lit(mix.share) * F.sum("a").over(Window.partitionBy("one")) - before) / rest
    level = F.max("found").over(Window.partitionBy("one"))
    return groups.withColumn("found", found).select(dimension, F.least(F.col("a"), level * F.col("s")).alias(f"t_{dimension}"))


def raked(dimension: str) -> Column:
    """w scaled so that the cells' expected tokens, none above its own, come nearer to the target of their group."""
    by = Window.partitionBy(dimension)
    is_full, target = F.col("w") >= FULL * F.col("tokens"), F.col(f"t_{dimension}")
    full = F.sum(F.when(is_full, F.col("tokens")).otherwise(0.0)).over(by)
    rest = F.sum(F.when(is_full, 0.0).otherwise(F.col("w"))).over(by)
    more = F.when(rest > 0, (target - full) / rest).otherwise(1.0)
    return F.col("w") * F.when(target > full + rest, more).otherwise(target / (full + rest))


def rake(cells: DataFrame, mix: Mix) -> DataFrame:
    """(keys, tokens) -> keys, tokens, targets, w: the tokens wanted of each cell, at most its own."""
    cells = materialize(cells.withColumn("tokens", F.col("tokens").cast("double")), "cells").coalesce(1)
    out = cells.withColumn("w", F.lit(mix.share) * F.col("tokens"))
    for d, p in zip(DIMENSIONS, mix.powers, strict=True):
        out = out.join(targets(cells, d, p, mix), d)
    out = materialize(out, "cells").coalesce(1)
    drop_scratch(cells)
    for done in range(0, mix.rounds, 4):  # a plan of four rounds at a time
        step = out
        for _ in range(min(4, mix.rounds - done)):
            for d in DIMENSIONS:
                step = step.withColumn("w", raked(d))
        step = materialize(step, "cells").coalesce(1)
        drop_scratch(out)
        out = step
    return out.withColumn("w", F.least("w", "tokens"))


def cells_of(docs_keyed: DataFrame) -> DataFrame:
    return docs_keyed.filter("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def margins(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """dimension, key, held, wanted, target, expected: tokens of each group, by its share alone, as it can be had, and as raked."""
    mix = mix or Mix()
    cells, out = rake(cells_of(keyed(docs)), mix), None
    for d, p in zip(DIMENSIONS, mix.powers, strict=True):
        m = cells.groupBy(d).agg(F.sum("tokens").alias("held"), F.first(f"t_{d}").alias("target"), F.sum("w").alias("expected"))
        m, every = m.withColumn("s", F.pow("held", F.lit(p))), Window.partitionBy(F.lit(d))
        wanted = F.lit(mix.share) * F.sum("held").over(every) * F.col("s") / F.sum("s").over(every)
        m = m.select(F.lit(d).alias("dimension"), F.col(d).alias("key"), "held", wanted.alias("wanted"), "target", "expected")
        out = m if out is None else out.unionByName(m)
    return out


def probabilities(docs_keyed: DataFrame, mix: Mix) -> DataFrame:
    """keys, probability of each cell."""
    return rake(cells_of(docs_keyed), mix).select(*DIMENSIONS, (F.col("w") / F.col("tokens")).alias("probability"))


def draw(mix: Mix) -> Column:
    """A number in [0, 1) from a document's id and tokens."""
    h = F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("tokens").cast("string")))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def drawn(k: DataFrame, mix: Mix) -> DataFrame:
    """Documents with cell keys and tokens, plus probability and sampled."""
    cells = materialize(probabilities(k.select(*DIMENSIONS, "tokens"), mix), "probabilities").coalesce(1)
    p = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return k.join(cells, list(DIMENSIONS), "left").withColumn("probability", p).withColumn("sampled", draw(mix) < F.col("probability"))


def report(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, sampled, for every document."""
    k = keyed(docs.select("doc_id", "text", "lang", "source")).drop("text")  # texts are read once; the rest is small
    return drawn(materialize(k, "keyed"), mix or Mix()).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled"
    )


def keep(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The drawn rows of docs, with its columns."""
    inner = [f"_m{i}" for i in range(len(docs.columns))]
    own = [F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True) if c in ("doc_id", "text", "lang", "source")]
    need = docs.toDF(*inner).select(*inner, *own)
    return drawn(keyed(need), mix or Mix()).filter("sampled").select(*inner).toDF(*docs.columns)


def oracle(mix: Mix | None = None) -> str:
    """The report as one SQL statement."""
    mix = mix or Mix()
    parts = [
        r"""docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t,
  coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens,
  CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS source_key, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS lang_key
  FROM documents)""",
        """keyed AS (SELECT *, CASE WHEN length(t) - length(replace(t, '|', '')) >= 3 THEN 'table'
  WHEN 50 * length(regexp_replace(t, '[^0-9]', '', 'g')) > length(t) THEN 'numeric'
  WHEN contains(t, '?') THEN 'question'
  WHEN (length(t) - length(replace(t, chr(10), ''))) * 100 > length(t) THEN 'listing' ELSE 'prose' END AS topic FROM docs)""",
        """cells AS (SELECT source_key, lang_key, topic, sum(tokens)::DOUBLE AS tokens FROM keyed WHERE tokens > 0 GROUP BY ALL)""",
    ]
    cols = []
    for d, p in zip(DIMENSIONS, mix.powers, strict=True):
        parts.append(f"g_{d} AS (SELECT {d}, sum(tokens) AS a, pow(sum(tokens), {p}::DOUBLE) AS s FROM cells GROUP BY {d})")
        parts.append(
            f"l_{d} AS (SELECT max(({mix.share}::DOUBLE * (SELECT sum(tokens) FROM cells) - coalesce(held, 0)) / rest) AS level FROM (SELECT "
            f"sum(a) OVER (ORDER BY a / s, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held, "
            f"sum(s) OVER (ORDER BY a / s, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g_{d}))"
        )
        cols.append(f"(SELECT least(a, level * s) FROM g_{d} x, l_{d} WHERE x.{d} = cells.{d}) AS t_{d}")
    parts.append(f"w0 AS MATERIALIZED (SELECT *, {mix.share}::DOUBLE * tokens AS w, {', '.join(cols)} FROM cells)")
    last = "w0"
    for r in range(mix.rounds):
        for k, d in enumerate(DIMENSIONS):
            name = f"w{r}_{k}"
            parts.append(
                f"{name} AS MATERIALIZED (SELECT * EXCLUDE (f, r) REPLACE (w * CASE WHEN t_{d} > f + r THEN CASE WHEN r > 0 THEN (t_{d} - f) / r ELSE 1 END "
                f"ELSE t_{d} / (f + r) END AS w) FROM (SELECT *, sum(CASE WHEN w >= {FULL}::DOUBLE * tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS f, "
                f"sum(CASE WHEN w >= {FULL}::DOUBLE * tokens THEN 0 ELSE w END) OVER (PARTITION BY {d}) AS r FROM {last}))"
            )
            last = name
    parts.append(f"p AS (SELECT source_key, lang_key, topic, least(w, tokens) / tokens AS p FROM {last})")
    draw = f"('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || tokens), 1, 12))::BIGINT / {1 << 48}::DOUBLE"
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 0), 6) AS probability, "
        f"{draw} < coalesce(p, 0) AS sampled FROM keyed LEFT JOIN p USING (source_key, lang_key, topic)"
    )
