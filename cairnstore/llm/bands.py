"""From shared bands to components, without listing the pairs of a band. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnstore.llm.common import among, checkpointed, discard
from cairnstore.llm.graph import connected_components


#: For how many of its leading grams an id meets one other before all pairs that are left are listed.
DRAWN = 8
#: Ids in a band whose pairs are compared by their parities; those of larger bands are looked up by their leading grams,
#: some eighty rows an id, so up to some thousand comparisons of numbers an id cost less. Both ways leave no pair out.
LISTED = 1024
#: How many finer bands stand for a band in which members are still apart, see `_split`.
SPLITS = 3
#: Longs of parities that are known of each set, and how many they are folded to where a row stands for one gram.
SIGNS, FOLDED = 16, 4
#: Rows that are compared at a time, or as many as there are ids if these are more: what is shuffled for one part of the
#: rows is dropped before the next, so disk is bounded by the number of ids, not by that of the rows they meet in.
PART_ROWS = 1_000_000


def labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the component of ``column`` as ``name``: itself where it has none."""
    named = labels.select(F.col("id").alias(column), F.col("component").alias("found"))
    return df.join(named, column, "left").withColumn(name, F.coalesce("found", column)).drop("found")


def _private(grams: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, u): the size of each set, and how many of its grams no other set among ``ids`` has."""
    rows = grams.join(ids, "id", "left_semi")
    alone = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("id")).where(F.col("n") == 1)
    alone = alone.groupBy("id").agg(F.count("*").alias("u"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    return checkpointed(sizes.join(alone, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u")))


def banded_components(
    met: DataFrame, measure: Callable[[DataFrame, bool], DataFrame], grams: DataFrame, percent: int
) -> DataFrame:
    """(id, component) of the linked ids.

    ``met`` (id, band, hub): the ids in each band, with the band's smallest id. ``grams`` (id, gram): their sets.
    ``measure(pairs, gate)`` gives (src, dst, a, r, both): the sizes of two sets without what they share, and what
    they share; with ``gate`` it may leave out pairs that are not alike by ``percent``, without it adds ``bits``: four
    longs with the bit (gram mod 256) set for each gram that only one of the two has. In turn
    1. each id meets the hub of the bands it shares most of;
    2. it meets its other hubs, unless the two are connected by now;
    3. in bands with ids that are still apart, every id meets the band's centre: the one with the least share of
       grams that no other of these sets has;
    4. ids that are not connected with the centre meet the band's other components, unless what is known rules a
       link out: two sets differ from the centre in a grams of their own, u of which nobody else has, and in r
       grams they lack, so they differ from each other in a + a' + r + r' - 2 (min(a - u, a' - u') + min(r, r'))
       grams at least.
    So every pair of a band is confirmed, refused or already connected, and none is listed that is ruled out.
    """

    def alike(measured: DataFrame) -> DataFrame:
        return measured.where(100 * F.col("both") >= percent * (F.col("a") + F.col("r") + F.col("both"))).select("src", "dst")

    def confirm(pairs: DataFrame) -> DataFrame:
        return alike(measure(pairs, True))

    shared = checkpointed(met.where(F.col("id") != F.col("hub")).groupBy("id", "hub").agg(F.count("*").alias("n")))
    first = shared.groupBy("id").agg(F.max(F.struct("n", (-F.col("hub")).alias("minus"))).alias("best"))
    first = first.select("id", (-F.col("best.minus")).alias("hub"))
    links = checkpointed(confirm(first.select(F.col("id").alias("src"), F.col("hub").alias("dst"))))
    labels = connected_components(links)

    def further(pairs: DataFrame) -> bool:
        """Confirm more pairs; false if there are none."""
        nonlocal links, labels
        pairs = checkpointed(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
        if pairs.isEmpty():
            return False
        links = checkpointed(links.unionByName(confirm(pairs)))
        labels = connected_components(links)
        return True

    def apart(rows: DataFrame, a: str, b: str) -> DataFrame:
        both = labelled(labelled(rows, labels, a, "c1"), labels, b, "c2")
        return both.where(F.col("c1") != F.col("c2"))

    further(apart(shared, "id", "hub").join(first, ["id", "hub"], "left_anti").select(F.col("id").alias("src"), F.col("hub").alias("dst")))
    bands = checkpointed(apart(met, "id", "hub").select("band").distinct())
    if bands.isEmpty():
        return labels
    here = checkpointed(among(met, "band", bands, exact=False).join(bands, "band").select("band", "id"))
    here = checkpointed(here.join(_private(grams, here.select("id").distinct()), "id"))
    centres = here.groupBy("band").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "id")).alias("least"))
    here = checkpointed(here.join(centres.select("band", F.col("least.id").alias("centre")), "band"))
    spokes = here.where(F.col("id") != F.col("centre")).select(F.col("id").alias("src"), F.col("centre").alias("dst")).distinct()
    spokes = checkpointed(measure(spokes, False))
    links = checkpointed(links.unionByName(alike(spokes)))
    labels = connected_components(links)
    spokes = spokes.select(F.col("src").alias("id"), F.col("dst").alias("centre"), "a", "r", "bits")
    here = checkpointed(here.join(spokes, ["id", "centre"]))  # without the centre, which has been met
    off = checkpointed(apart(here, "id", "centre").select("band", "id", "n", "u", "a", "r", "bits", "c1"))
    if off.isEmpty():
        return labels
    every = labelled(here.join(off.select("band").distinct(), "band", "left_semi"), labels, "id", "c2")
    every = every.select("band", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "u", "a", "r", "bits")], "c2")
    common, one, two = F.lit(0), F.lit(0), F.lit(0)
    for k in range(4):
        x, y = F.get("bits", F.lit(k)), F.get("bits2", F.lit(k))
        common, one, two = common + F.bit_count(x.bitwiseAND(y)), one + F.bit_count(x), two + F.bit_count(y)
    d, d2 = F.col("a") + F.col("r"), F.col("a2") + F.col("r2")
    by_bits = common + F.least(d - one, d2 - two)
    by_size = F.least(F.col("a") - F.col("u"), F.col("a2") - F.col("u2")) + F.least("r", "r2")
    differ = d + d2 - 2 * F.least(by_bits, by_size)
    possible = (100 - percent) * (F.col("n") + F.col("n2")) >= (100 + percent) * differ
    cross = off.join(every, "band").where((F.col("c1") != F.col("c2")) & possible)
    further(cross.select(F.col("id").alias("src"), F.col("id2").alias("dst")))
    return labels


def part(rows: DataFrame, column: str, k: int, parts: int) -> DataFrame:
    """The rows of the ``k``-th of ``parts`` by hash of ``column``."""
    return rows.where(F.pmod(F.xxhash64(column), F.lit(parts)) == k) if parts > 1 else rows


def sized_bands(banded: DataFrame, parts: int = 1) -> DataFrame:
    """(id, size, band, m): the rows of ``banded`` (id, size, band; without repeats) whose band holds m ids, two or more.

    ``size`` is how much text an id stands for. Bands of two are known by their smallest and largest id; only rows of
    larger ones are read a second time. Bands are counted in as many ``parts``, one after the other.
    """
    member = F.struct("id", "size")

    def shared(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("band").agg(F.count("*").alias("m"), F.min(member).alias("low"), F.max(member).alias("high"))
        return checkpointed(sizes.where(F.col("m") > 1))

    each = [shared(part(banded, "band", k, parts)) for k in range(parts)]
    sizes = reduce(DataFrame.unionByName, each)
    two = sizes.where(F.col("m") == 2).select(F.inline(F.array("low", "high")), "band", "m")
    large = sizes.where(F.col("m") > 2).select("band", "m")
    more = among(banded, "band", large, exact=False).join(large, "band").select("id", "size", "band", "m")
    out = checkpointed(two.unionByName(more))
    discard(*each)
    return out


def _hubs(met: DataFrame) -> DataFrame:
    """``met`` (id, size, band, m) with the hub of each band: its most typical member.

    That is the one whose bands hold most ids, taken over all its bands, and of equals the one of least text, as it
    has least besides what they share.
    """
    own = Window.partitionBy("id")  # an id has as many rows as it has features
    ranked = checkpointed(met.withColumn("score", F.round(F.sum(F.log2("m")).over(own))))
    typical = F.max(F.struct("score", (-F.col("size")).alias("short"), (-F.col("id")).alias("minus"), "id")).alias("top")
    hubs = ranked.groupBy("band").agg(typical).select("band", F.col("top.id").alias("hub"))
    out = checkpointed(ranked.drop("score", "size").join(hubs, "band"))
    discard(ranked)
    return out


def leading(n, percent: int):
    """How many of the first of n grams hold one of every set of at least as many grams that is alike by ``percent``."""
    return n - F.ceil(percent * n / 100) + 1


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (id, n, bits, at, gram) of the grams that ids of several components have, with the component c.

    ``off`` tells the ids that are not in the gram's largest component.
    """
    rows = labelled(rows, labels, "id", "c")
    each = rows.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram")
    mixed = each.agg(F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("most")).where(F.col("parts") > 1)
    mixed = checkpointed(mixed.select("gram", F.col("most.c").alias("main")))
    rows = among(rows, "gram", mixed, exact=False).join(mixed, "gram")
    return checkpointed(rows.withColumn("off", F.col("c") != F.col("main")).drop("main"))


def _bounded(percent: int, words: int, one: str = "{}", two: str = "{}2"):
    """Whether sets (n, bits; n2, bits2, or columns so named) may be alike by ``percent``.

    What they share cancels out of their parities, so each bit that differs is a gram at least that only one has.
    """
    n, n2, bits, bits2 = (F.col(name.format(x)) for x in ("n", "bits") for name in (one, two))
    differ = sum(F.bit_count(F.get(bits, F.lit(k)).bitwiseXOR(F.get(bits2, F.lit(k)))) for k in range(words))
    return (100 - percent) * (n + n2) >= (100 + percent) * differ


def _folded(bits: str):
    """The parities of the cells of `SIGNS` longs, in `FOLDED` longs of cells as many times as large."""
    return F.array(*[reduce(Column.bitwiseXOR, [F.get(bits, F.lit(k)) for k in range(j, SIGNS, FOLDED)]) for j in range(FOLDED)])


def _possible(percent: int):
    """Whether ids of two components (id, n, bits, c; id2, ...) may be alike by ``percent``."""
    return (F.col("c") != F.col("c2")) & _bounded(percent, FOLDED)


def _early(percent: int):
    """Whether a gram at the places ``at`` and ``at2`` may be the first that two sets alike by ``percent`` share.

    Such sets of x and y grams share percent / (100 + percent) * (x + y) at least, so it leaves that many in both.
    """
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (100 + percent) * left >= percent * (F.col("n") + F.col("n2"))


def _second(rows: DataFrame) -> DataFrame:
    return rows.select("gram", *[F.col(x).alias(f"{x}2") for x in ("id", "n", "c", "at", "bits")])


def _one_for_all(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): each id of ``rows`` with one id for each of its grams, drawn by hash."""
    drawn = F.min_by(F.struct("id", "n", "c", "at", "bits"), F.xxhash64("id", "gram")).alias("one")
    hubs = _second(rows.groupBy("gram").agg(drawn).select("gram", "one.*"))
    found = rows.join(hubs, "gram").where(_early(percent) & _possible(percent))
    return checkpointed(found.select(F.greatest("id", "id2").alias("src"), F.least("id", "id2").alias("dst")).distinct())


def _apart(here: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, band, m, c, off) of the bands of ``here`` with members of several components.

    ``off`` tells the ids that are not in the largest component of the band.
    """
    rows = labelled(here.where(F.col("m") > 2).select("id", "band", "m"), labels, "id", "c")
    each = rows.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band")
    mixed = each.agg(F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("most")).where(F.col("parts") > 1)
    rows = rows.join(mixed.select("band", F.col("most.c").alias("main")), "band")
    return checkpointed(rows.select("id", "band", "m", "c", (F.col("c") != F.col("main")).alias("off")))


def _split(rows: DataFrame, k: int) -> DataFrame:
    """(src, dst): ids of ``rows`` (id, band, c, off) that are off, with two ids of each of their finer bands.

    A finer band holds the ids of a band whose other bands have the same least hash, in the ``k``-th of `SPLITS` ways of
    hashing, as alike sets have many bands in common; at ``k`` = `SPLITS` it is all of the band. The two are one of the
    band's largest component and one that is off. That is as many pairs as rows at most, times two, however large bands
    are.
    """
    if k == SPLITS:
        key = F.xxhash64("band", F.lit(k))
    else:
        hashed = F.xxhash64("band", F.lit(k))
        own = Window.partitionBy("id")  # an id has as many rows as it has features
        least = F.slice(F.sort_array(F.collect_list(hashed).over(own)), 1, 2)
        other = F.when(F.get(least, F.lit(0)) == hashed, F.get(least, F.lit(1))).otherwise(F.get(least, F.lit(0)))
        key = F.when(other.isNotNull(), F.xxhash64("band", other, F.lit(k)))
    finer = checkpointed(rows.select("id", "c", "off", key.alias("key")).where(F.col("key").isNotNull()))
    drawn = F.struct(F.xxhash64("id", "key").alias("hash"), "id", "c")
    most = finer.groupBy("key").agg(F.min(F.when(F.col("off"), drawn)).alias("one"), F.min(F.when(~F.col("off"), drawn)).alias("two"))
    most = most.where(F.col("one").isNotNull())
    found = finer.where("off").join(most, "key").select("id", "c", F.explode(F.array("one", "two")).alias("met"))
    found = found.where(F.col("c") != F.col("met.c")).select("id", F.col("met.id").alias("id2"))
    pairs = checkpointed(found.select(F.greatest("id", "id2").alias("src"), F.least("id", "id2").alias("dst")).distinct())
    discard(finer)
    return pairs


def _listed(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): all pairs of a band of ``rows`` (band, id, n, bits, c, off) that may be alike."""
    one, two = rows.alias("one"), rows.alias("two")  # of one plan, so that they are dealt out once
    apart = F.col("one.off") & (F.col("one.c") != F.col("two.c")) & (~F.col("two.off") | (F.col("one.id") > F.col("two.id")))
    possible = apart & _bounded(percent, SIGNS, "one.{}", "two.{}")
    found = one.join(two, (F.col("one.band") == F.col("two.band")) & possible)
    src, dst = F.greatest("one.id", "two.id"), F.least("one.id", "two.id")
    return found.select(src.alias("src"), dst.alias("dst")).distinct()


def _all_apart(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): all pairs of ``rows`` that may be alike, but for two of a gram's largest component.

    The first gram that two share is one of the first n - 2 * percent / (100 + percent) * n + 1 of the smaller set.
    """
    low = rows.where(F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)))
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    possible = ordered & _early(percent) & _possible(percent)
    found = low.where("off").join(_second(rows), "gram").where(possible)
    found = found.unionByName(low.where("not off").join(_second(rows.where("off")), "gram").where(possible))
    return checkpointed(found.select(F.col("id").alias("src"), F.col("id2").alias("dst")).distinct())


def feature_components(
    met: DataFrame,
    signs: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    first_grams: Callable[[DataFrame], DataFrame],
    percent: int,
) -> DataFrame:
    """(id, component) of the linked ids, from ``met`` as `sized_bands` gives it, which is discarded.

    ``signs`` (id, n, bits): of each id's set, how many grams it has, and `SIGNS` longs with a bit for each cell of
    hashes: whether the number of grams in it is odd. ``confirm(pairs)`` gives the links among (src, dst), which are alike by ``percent``, and needs to be
    exact. ``first_grams(ids)`` gives (id, grams) for ``ids``: the `leading` grams of each set in one order for all
    sets, rare ones first. In turn
    1. every id meets the most typical member of each of its bands (`_hubs`);
    2. in bands with members that are still apart, those outside the largest component of the band meet two members of
       finer bands (`_split`);
    3. in bands of 3 to `LISTED` ids with members that are still apart, all pairs of two components that may be alike are
       confirmed or refused; ids of larger such bands meet one other for each of their first `DRAWN` leading grams;
    4. of the ids of these larger bands every pair with a leading gram in common that may be alike and is not connected
       by now is confirmed or refused, so all pairs that are alike are, as these share a leading gram.
    So no pair that shares a band is left undecided, however unlike the band's most typical member its two ids are, and
    none is refused but by a bound that no pair that is alike can break, or by ``confirm``.
    Pairs are compared, and bands listed, in parts of some `PART_ROWS` rows, one after the other.
    The pairs of a large band are not listed: what many sets have in common is not among the leading grams of a set,
    unless nearly all it has is common, and then the steps before have connected most of them.
    """
    at_once = max(PART_ROWS, signs.count())

    def parts(rows: DataFrame) -> int:
        return 1 + rows.count() // at_once

    def bounded(pairs: DataFrame, signs: DataFrame, words: int) -> DataFrame:
        two = signs.select(F.col("id").alias("dst"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
        met = pairs.join(two, "dst").join(signs.withColumnRenamed("id", "src"), "src")
        return met.where(_bounded(percent, words)).select("src", "dst")

    def of(ids: DataFrame) -> DataFrame:
        return among(signs, "id", ids, exact=False)  # parities are wide: those of other ids need not be dealt out

    def joined(tables: list[DataFrame]) -> DataFrame:
        """One table of several, which are discarded."""
        out = checkpointed(reduce(DataFrame.unionByName, tables).distinct()) if len(tables) > 1 else tables[0]
        discard(*(tables if len(tables) > 1 else []))
        return out

    def hopeful(pairs: DataFrame, many: int) -> DataFrame:
        """Those of ``pairs`` that parities do not refuse, in ``many`` parts: folded parities first, then all of those left."""
        folded = signs.select("id", "n", _folded("bits").alias("bits"))
        few = joined([checkpointed(bounded(part(pairs, "dst", k, many), folded, FOLDED)) for k in range(many)])
        found = checkpointed(bounded(few, of(few.select(F.explode(F.array("src", "dst")).alias("id"))), SIGNS))
        discard(few)
        return found

    def links_of(pairs: DataFrame) -> DataFrame:
        return checkpointed(confirm(pairs))

    here = _hubs(met)
    discard(met)
    spokes = here.where(F.col("id") != F.col("hub")).select(F.col("id").alias("src"), F.col("hub").alias("dst")).distinct()
    pairs = hopeful(spokes, parts(here))
    links = links_of(pairs)
    discard(pairs)
    labels = connected_components(links)
    apart = _apart(here, labels)
    if apart.isEmpty():
        return labels

    def further(pairs: DataFrame) -> None:
        nonlocal links, labels
        before, more = (links, labels), links_of(pairs)
        links = checkpointed(links.unionByName(more))
        labels = connected_components(links)
        discard(more, *before)

    finer = []
    for k in range(SPLITS + 1):
        pairs = _split(apart, k)
        finer.append(hopeful(pairs, parts(pairs)))
        discard(pairs)
    pairs = joined(finer)
    further(pairs)
    discard(apart, pairs)
    apart = _apart(here, labels)
    discard(here)
    large = checkpointed(apart.where(F.col("m") > LISTED).select("id").distinct())
    listed = apart.where(F.col("m") <= LISTED).select("id", "band", "c", "off")
    many, each = parts(apart), []
    for k in range(many):
        some = part(listed, "band", k, many)
        each.append(checkpointed(_listed(some.join(of(some), "id"), percent)))
    pairs = joined(each)
    if large.isEmpty():
        further(pairs)
        discard(apart, pairs)
        return labels
    first = first_grams(large).join(of(large).select("id", "n", _folded("bits").alias("bits")), "id")
    first = checkpointed(first)
    rows = first.select("id", "n", "bits", F.posexplode("grams").alias("at", "gram"))
    drawn = _one_for_all(_mixed(rows.where(F.col("at") < DRAWN), labels), percent)
    pairs = joined([pairs, hopeful(drawn, parts(drawn))])
    further(pairs)
    discard(apart, drawn, pairs)
    rest = _all_apart(_mixed(rows, labels), percent)
    pairs = hopeful(rest, parts(rest))
    further(pairs)
    discard(first, rest, pairs)
    return labels
