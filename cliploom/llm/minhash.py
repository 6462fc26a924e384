"""MinHash near-dedup by an inverted join on signature coordinates.

Documents of equal shingle sets are one class. A class has a signature of ``COORDINATES`` minima
and is posted under (coordinate, value) pairs. Two classes at the similarity threshold agree in at
least ``least_matches(percent)`` coordinates but for a chance of about one in a million, so

* prefix: with its pairs in ascending order of frequency, a class needs posting only under the first
  ``COORDINATES - least_matches + 1``; pairs that no other class has fill places without being posted;
* skip: a class whose prefix holds such pairs only is skipped, and so is one of whose shingles so
  many are found in no other posted class that the threshold is out of reach (an exact bound);
* count: collisions of a candidate pair's signatures are counted, and pairs with fewer go.

Kept pairs are confirmed on the full sets. A list of N classes isn't turned into its N * N pairs:

* each list first joins its members to one hub, the member with the fewest shingles of its own, and
  the confirmed links are turned into components. Members of one component need no further
  comparison, as components are what is asked for;
* of a list with members in several components, short ones (``SHORT`` members) have those pairs
  compared that lie in different components;
* in longer ones a member is written as its differences from the hub, the shingles that only one of
  both has. Two members are as far apart as their differences are, so a link needs many differences
  in common; ``within_bounds`` has the exact bound. Where everybody differs from the hub in
  ways of their own, as copies with random edits do, no pairs are left;
* where differences are shared, ``MORE_HUBS`` of the members left outside the hub's component become hubs in
  their turn, components are joined, and so on as long as a round halves the members left. Only then are
  pairs made, of members that meet in a rare difference (``differences_in_common``).

``exact=True`` finds every link: candidates come from a prefix join on the shingles themselves, rarest first, and
signatures aren't asked. It posts a seventh of all shingles instead of a few dozen pairs a class.

Defined results: null and empty texts have empty sets and are linked with nothing; texts of fewer
than five words have their whole word sequence as one shingle; a null doc_id is linked with
nothing, has a null component and is kept; rows that share a doc_id are judged by their own texts;
texts are read whole; an empty table gives no rows; ``dedup`` keeps other columns as they are.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, map_rows, materialize, release
from .substring import WordHashes, mix, run_hash

SHINGLE = 5
COORDINATES = 64
#: Links need 100 * intersection >= percent * union; this is the contract of op3.
PERCENT = 85
#: The chance that a link right at the threshold agrees in too few coordinates.
MISS = 2.5e-6
#: Hubs a round, of a list whose members share differences.
MORE_HUBS = 12
#: Lists of up to so many members have their pairs compared; both ways are exact.
SHORT = 16


def least_matches(percent: int) -> int:
    """Coordinates that links must agree in: as many as leave a link at the threshold a chance below MISS to be missed."""
    p, missed = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        missed += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed >= MISS:
            return m
    return COORDINATES


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240501)
    return r.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, COORDINATES, np.uint64)


_A, _B = _permutations()


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < SHINGLE:
        return run_hash(h, np.zeros(1, np.int64), len(words), 100 + len(words))
    s = np.sort(run_hash(h, np.arange(len(words) - SHINGLE + 1), SHINGLE, 7))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES minima of 32 bits, in slices so that a long text needs no large matrix."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(out, (((s[at : at + 2048, None] ^ _B) * _A) >> np.uint64(32)).min(0), out=out)
    return out.astype("<u4")


def set_key(s: np.ndarray) -> bytes:
    """A class id: a 128-bit digest of the set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), c (class id, null for empty sets), sig (int array)."""

    def each(batches):
        hashes = WordHashes()
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                s = shingles(t, hashes)
                if len(s) and i is not None:
                    rows.append((i, len(s), set_key(s), signature(s).view("<i4")))
                else:
                    rows.append((i, len(s), None, None))
            yield rows

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n int, c binary, sig array<int>", each)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """c, s (sorted shingle hashes) of each row with a set."""

    def each(batches):
        hashes = WordHashes()
        for (texts,) in batches:
            rows = []
            for t in texts:
                s = shingles(t, hashes)
                if len(s):
                    rows.append((set_key(s), s.view(np.int64)))
            yield rows

    return map_rows(docs, ["text"], "c binary, s array<long>", each)


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, c (class id) of the rows with a set."""

    def each(batches):
        hashes = WordHashes()
        for ids, texts in batches:
            yield [(i, t, set_key(s)) for i, t in zip(ids, texts, strict=True) if len(s := shingles(t, hashes))]

    return map_rows(docs, ["doc_id", "text"], "doc_id long, text string, c binary", each)


def prefix_posts(classes: DataFrame, percent: int) -> DataFrame:
    """(c, n, sig) -> token, c: the postings of the rarest coordinate-value pairs within the prefix."""
    token = F.expr("transform(sig, (v, j) -> shiftleft(cast(j as bigint), 32) | (cast(v as bigint) & 4294967295))")
    tokens = classes.select("c", F.explode(token).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = tokens.join(common, "token").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    # pairs of no other class come first in frequency and fill the prefix
    room = F.size("t") - F.lit(least_matches(percent) - 1)
    posted = mine.filter(room > 0).select("c", F.explode(F.slice("t", F.lit(1), room)).alias("t")).select("c", "t.token")
    shared = posted.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    return posted.join(shared, "token")


def within_reach(sets: DataFrame, percent: int) -> DataFrame:
    """(c, n, s) -> c, own: classes that have few enough shingles which no other posted class has.

    A link needs ``percent`` of the union, so ``percent`` of either set must be shared.
    """
    each = sets.select("c", F.explode("s").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h")
    shared = each.join(common, "h").groupBy("c").agg(F.count("*").alias("shared"))
    return sets.join(shared, "c").filter(100 * F.col("shared") >= percent * F.col("n")).select("c", (F.col("n") - F.col("shared")).alias("own"))


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Can sets of n and m shingles be similar enough, if they have at most ``shared`` in common?"""
    return 100 * shared >= percent * (n + m - shared)


def matches() -> Column:
    return F.expr("aggregate(zip_with(sig_a, sig_b, (x, y) -> if(x = y, 1, 0)), 0, (acc, x) -> acc + x)")


def exact_posts(sets: DataFrame, percent: int) -> DataFrame:
    """(c, n, s) -> token, c: the rarest shingles of each set, so many that two sets that can be linked share one of them."""
    each = sets.select("c", "n", F.explode("s").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = each.join(common, "token").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    # shingles of no other set come first and fill the prefix
    need = F.ceil(F.col("n") * percent / 100)
    room = (F.size("t") - need + 1).cast("int")
    posted = mine.filter(room > 0).select("c", F.explode(F.slice("t", F.lit(1), room)).alias("t")).select("c", "t.token")
    return posted.join(posted.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token"), "token")


def confirm(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b) candidates -> those that agree in ``least`` coordinates and whose sets are similar enough."""
    side = lambda x: sigs.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (matches() >= least)).select("a", "b", "n_a", "n_b")
    s = lambda x: sets.select(F.col("c").alias(x), F.col("s").alias(f"s_{x}"))
    p = p.join(s("a"), "a").join(s("b"), "b").withColumn("i", F.size(F.array_intersect("s_a", "s_b")))
    return p.filter(100 * F.col("i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> c, label: the smallest node each node reaches, by neighbour minima and pointer jumps."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("label")), "label")
    while True:  # labels only fall, and a round without a change is the last
        near = both.join(label, both.b == label.c).groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(near, label.c == near.a).select("c", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        ahead = new.select(F.col("c").alias("to"), F.col("to").alias("jump"))
        new = materialize(new.join(ahead, "to", "left").select("c", F.coalesce("jump", "to").alias("label"), "was"), "label")
        changed = new.filter("label <> was").limit(1).count()
        drop_scratch(label)
        label = new.drop("was")
        if not changed:
            drop_scratch(both)
            return label


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after more links, which lie between components: these are joined, not their members again."""
    ends = more.select(F.col("a").alias("c")).unionByName(more.select(F.col("b").alias("c"))).distinct()
    label = materialize(label.unionByName(ends.join(label, "c", "left_anti").select("c", F.col("c").alias("label"))), "label")
    side = lambda x: label.select(F.col("c").alias(x), F.col("label").alias(f"to_{x}"))
    bridges = more.join(side("a"), "a").join(side("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    top = components(bridges).select(F.col("c").alias("label"), F.col("label").alias("to"))
    return label.join(top, "label", "left").select("c", F.coalesce("to", "label").alias("label"))


def still_apart(posts: DataFrame, hubs: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """token, hub, c, label, n, s (shingles it may share), m (members): lists with members in several components, without
    members that share too little for a link with the smallest partner that their list and their own size allow."""
    member = posts.join(hubs, "token").join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
    several = lambda d, *more: d.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), *more).filter("x <> y").drop("x", "y")
    smallest = F.greatest("least_n", F.ceil(F.col("n") * percent / 100))
    shared = F.col("n") - F.col("own")
    member = member.join(several(member, F.min("n").alias("least_n")), "token").filter(_enough(shared, F.col("n"), smallest, percent))
    member = materialize(member.select("token", "hub", "c", "label", "n", shared.alias("s")), "apart")
    return member.join(several(member, F.count("*").alias("m")), "token")


def pairs_of_short_lists(member: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that meet in a list; a pair counts in the first list that it meets in."""
    toks = posts.groupBy("c").agg(F.array_sort(F.collect_list("token")).alias("toks"))
    member = materialize(member.select("token", "c", "label", "n", "s").join(toks, "c"), "short")
    other = member.select("token", *[F.col(x).alias(f"{x}_b") for x in ("c", "label", "n", "s", "toks")])
    meet = F.array_min(F.array_intersect("toks", "toks_b")) == F.col("token")
    fits = _enough(F.least("s", "s_b"), F.col("n"), F.col("n_b"), percent)
    pairs = member.join(other, "token").filter((F.col("label") != F.col("label_b")) & (F.col("c") < F.col("c_b")) & fits & meet)
    return pairs.select(F.col("c").alias("a"), F.col("c_b").alias("b"))


def differences(member: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """hub, c, label, n, near (in the hub's component), d: a member's differences from the hub of its list."""
    side = sets.select(F.col("c").alias("hub"), F.col("s").alias("s_hub"))
    home = label.select(F.col("c").alias("hub"), F.col("label").alias("home"))
    m = member.filter("c <> hub").select("hub", "c", "label", "n").distinct().join(home, "hub", "left")
    m = m.join(sets.select("c", "s"), "c").join(side, "hub")
    d = F.concat(F.array_except("s", "s_hub"), F.array_except("s_hub", "s"))
    return m.select("hub", "c", "label", "n", (F.col("label") == F.coalesce("home", "hub")).alias("near"), d.alias("d"))


def shared_differences(diffs: DataFrame, percent: int) -> DataFrame:
    """(hub, c, label, n, near, d) -> hub, c, label, near, low, top, es: the differences that others of the list have as well, rarest first.

    With D the differences, a link of a and b needs ``2 * (100 + percent) * |Da & Db| >= low(a) + low(b)``, where
    ``low = (100 + percent) * |D| - (100 - percent) * n``. As |Da & Db| is at most the number of differences of
    either one that others have as well, ``top(a) = 2 * (100 + percent) * shared(a) - low(a)`` is the most that
    ``low(b)`` may be.
    """
    unit = 100 + percent
    each = diffs.select("hub", "c", F.explode("d").alias("e"))
    common = each.groupBy("hub", "e").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(common, ["hub", "e"]).groupBy("hub", "c").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
    low = (unit * F.size("d") - (100 - percent) * F.col("n")).cast("long")
    x = diffs.select("hub", "c", "label", "near", low.alias("low")).join(shared, ["hub", "c"])
    return x.withColumn("top", 2 * unit * F.size("es") - F.col("low"))


def within_bounds(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members outside the hub's component (far, with near_low of their list) that may be linked with some of their list, and
    those that may be linked with far ones (with far_low)."""
    far = x.filter("not near").groupBy("hub").agg(F.min("low").alias("far_low"))
    partner = x.join(far, "hub").filter("top >= far_low")
    reach = partner.groupBy("hub").agg(F.min("low").alias("near_low"), F.max("top").alias("near_top"))
    return x.filter("not near").join(reach, "hub").filter("low <= near_top and top >= near_low"), partner


def _may_link(near: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """(a, b) of members of different components within reach of one another."""
    other = other.select(*on, *[F.col(k).alias(f"{k}_b") for k in ("c", "label", "low", "top")])
    fits = (F.col("label") != F.col("label_b")) & (F.col("top_b") >= F.col("low")) & (F.col("top") >= F.col("low_b"))
    return near.join(other, on).filter(fits).select(F.least("c", "c_b").alias("a"), F.greatest("c", "c_b").alias("b")).distinct()


def hub_rounds(x: DataFrame, label: DataFrame, confirmed, percent: int) -> tuple[DataFrame, DataFrame]:
    """More hubs for the members that are left (see the top) -> shared differences with new labels, and all labels."""
    before = None
    while True:
        far, partner = within_bounds(x)
        far = materialize(far, "far")
        n = far.count()
        if n <= SHORT or before is not None and 2 * n > before:
            drop_scratch(far)
            return x, label
        before, order = n, Window.partitionBy("hub").orderBy(F.xxhash64("c"), "c")
        hubs = far.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= MORE_HUBS)
        links = confirmed(_may_link(partner, hubs, ["hub"]))
        drop_scratch(far)
        if not links.limit(1).count():
            return x, label
        label, old = materialize(_joined(label, links), "label"), (x, label)
        home = label.select(F.col("c").alias("hub"), F.col("label").alias("home"))
        x = x.drop("label", "near").join(label, "c", "left").withColumn("label", F.coalesce("label", "c")).join(home, "hub", "left")
        x = materialize(x.withColumn("near", F.col("label") == F.coalesce("home", "hub")).drop("home"), "differ")
        for done in (links, *old):
            drop_scratch(done)


def differences_in_common(x: DataFrame, percent: int) -> DataFrame:
    """Shared differences -> (a, b): pairs of one list and of different components that may be linked.

    One of a pair is outside the hub's component (far), and low(a) + low(b) is above zero then, so the
    pair meets in a difference of both, and in one of the rarest, as in any prefix join.
    """
    far, partner = within_bounds(x)

    def posted(d: DataFrame, least: str) -> DataFrame:
        need = F.greatest(F.lit(1), F.ceil((F.col("low") + F.col(least)) / (2 * (100 + percent))))
        room = (F.size("es") - need + 1).cast("int")
        return d.filter(room > 0).select("hub", "c", "label", "low", "top", F.explode(F.slice("es", F.lit(1), room)).alias("e")).withColumn("e", F.col("e.e"))

    return _may_link(posted(far, "near_low"), posted(partner, "far_low"), ["hub", "e"])


def comparable(docs: DataFrame, classes: DataFrame, percent: int, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """posts (token, c, own, rep, n), sets (c, n, s) and sigs (c, n, sig) of the classes (c, key, rep, n, sig) within reach of a link: no others go through the joins that confirm links."""
    spark = docs.sparkSession
    found = None if exact else materialize(prefix_posts(classes, percent), "posts")
    release(spark)
    # one row of each posted class brings its set
    reps = (classes if exact else classes.join(found.select("c").distinct(), "c", "left_semi")).select("c", "key", "n", F.col("rep").alias("doc_id"))
    brought = docs.select("doc_id", "text").join(reps.select("doc_id"), "doc_id", "left_semi")
    sets = shingle_sets(brought).groupBy(F.col("c").alias("key")).agg(F.first("s").alias("s"))
    every = materialize(sets.join(reps.select("c", "key", "n"), "key").select("c", "n", "s"), "sets")
    release(spark)
    if exact:
        found = materialize(exact_posts(every, percent), "posts")
        release(spark)
    near = materialize(within_reach(every, percent), "reach")
    posts = materialize(found.join(near, "c").join(classes.select("c", "rep", "n"), "c"), "posts")
    sets = materialize(every.join(near, "c", "left_semi"), "sets")
    sigs = materialize(classes.join(near, "c", "left_semi").select("c", "n", "sig"), "sigs")
    for done in (found, every, near):
        drop_scratch(done)
    release(spark)
    return posts, sets, sigs


def near_duplicates(docs: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and c: the class of equal sets (null where nothing can be linked).

    Links are pairs of a similarity of ``percent`` or more: all but a few in a million right at the threshold, or all if ``exact``.
    """
    spark = docs.sparkSession
    rows = materialize(signatures(docs), "signatures")
    # a written number stands for a class from here on, as digests make up most of what is shuffled
    classes = rows.filter("c is not null").groupBy(F.col("c").alias("key")).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    release(spark)
    posts, sets, sigs = comparable(docs, classes, percent, exact)
    least = 0 if exact else least_matches(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        links = materialize(confirm(pairs, sigs, sets, percent, least), "links")
        release(spark)
        return links

    hubs = posts.groupBy("token").agg(F.min_by("c", F.struct("own", "rep")).alias("hub"))
    star = posts.join(hubs, "token").filter("c <> hub").select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    links = confirmed(star)
    first = components(links)

    apart = materialize(still_apart(posts, hubs, first, percent), "apart")
    rest = pairs_of_short_lists(apart.filter(F.col("m") <= SHORT), posts, percent)
    longer, label = apart.filter(F.col("m") > SHORT), first
    if longer.limit(1).count():
        diffs = materialize(differences(longer, sets, first), "diffs")
        x, label = hub_rounds(materialize(shared_differences(diffs, percent), "differ"), first, confirmed, percent)
        rest = rest.unionByName(differences_in_common(x, percent)).distinct()
    rest = rest.join(star, ["a", "b"], "left_anti")
    more = confirmed(rest)
    label = label if not more.limit(1).count() else _joined(label, more)

    home = classes.select("c", "key", "rep").join(label, "c", "left")
    linked = home.filter("label is not null").groupBy("label").agg(F.min("rep").alias("component_id"))
    home = materialize(home.join(linked, "label", "left").select(F.col("key").alias("c"), F.coalesce("component_id", "rep").alias("component_id")), "home")
    for done in (classes, sets, sigs, posts, links, more, label):
        drop_scratch(done)
    out = rows.select("doc_id", "n", "c").join(home, "c", "left")
    # an empty set is a component of its own
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), "c")


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one document of each group."""
    judged = near_duplicates(docs, percent).groupBy("doc_id")
    judged = judged.agg(F.max("kept").alias("some_stay"), F.collect_set(F.when(~F.col("kept"), F.col("c"))).alias("copies"))
    gone = materialize(judged.filter(F.size("copies") > 0), "gone")
    out = docs.join(gone.filter("not some_stay").select("doc_id"), "doc_id", "left_anti")
    # of a doc_id whose rows differ, only those go whose own text was judged a copy
    some = gone.filter("some_stay").select("doc_id", F.explode("copies").alias("c"))
    if some.limit(1).count():
        texts = classes_of(docs.join(some.select("doc_id").distinct(), "doc_id", "left_semi"))
        copies = materialize(texts.join(some, ["doc_id", "c"], "left_semi").select("doc_id", "text").distinct(), "copies")
        out = out.join(copies, ["doc_id", "text"], "left_anti")
    return out.select(*[f"`{c}`" for c in docs.columns])
