"""Links within families of similar sets, derived from what each member shares with the family's head.

Sets that share routes (minimum hashes or bands) adopt the same head: of all sets on a route the one with the highest score,
and of the heads of a set's routes the one that most of them name. A member is its head and a small difference: d = x △ a, l shingles
that it lacks and o that it has besides. All answers follow from the head's by these differences alone: with S = |d_x & d_y|

    |x & y| = |a| - l_x - l_y + S,

so x and y are linked just where (100 + p) S >= w_x + w_y - (100 - p) |a|, with w = 100 l + p o. A member with w <= (100 - p) |a|
is linked with the head itself; two such members need no answer, since the head connects them. For one that is apart, e = w - (100 - p) |a|
is above 0, and a partner must share more than w_y / (100 + p) of its differences, which an index over the differences finds: prefixes in
the order of rarity within the family, entries skipped by their positions. No pair is lost, and a group of many copies costs a
comparison each and not one for each pair.

The pairs of a group that many links connect are never listed. First each entry of that index meets one entry of its list only, that
closest to the head, then the two that the components so far put furthest apart; what these links and the heads' connect needs no other
answer, and only entries of different components meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written
from sparkloom.llm.components import components
from sparkloom.llm.hashes import mixed

#: Members of one head that meet in one key of a join.
SHARE = 500
#: Entries of a list that meet as one block.
BLOCK_ENTRIES = 64
MINIMA = 8


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repetitions."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def minima(s: np.ndarray) -> np.ndarray:
    """Of each of `MINIMA` orders the element of a set that comes first; none of an empty set."""
    h = s.astype(np.int64).view(np.uint64)
    return s[[int(np.argmin(mixed(h, k))) for k in range(MINIMA if len(s) else 0)]]


def all_minima(items: np.ndarray, count: np.ndarray) -> np.ndarray:
    """`minima` of many sets that lie one after the other, a row for each; none is empty."""
    first = np.cumsum(count) - count
    out = np.empty((len(count), MINIMA), np.int64)
    for k in range(MINIMA if len(count) else 0):
        h = mixed(items.view(np.uint64), k)  # one to one: each set has one place with its least
        out[:, k] = items[h == np.repeat(np.minimum.reduceat(h, first), count)]
    return out


def heads(routes: DataFrame) -> DataFrame:
    """(rid, g) from (rid, round, token, score): the head that most of a set's routes name, where that isn't the set itself."""
    top = routes.groupBy("round", "token").agg(F.max(F.struct("score", "rid")).alias("top"), F.count("*").alias("count")).filter("count > 1")
    top = written(top.select("round", "token", F.col("top.rid").alias("g"), F.col("top.score").alias("high")), "tops")
    votes = routes.join(top, ["round", "token"]).groupBy("rid", "g").agg(F.count("*").alias("votes"), F.max("high").alias("high"))
    chosen = written(votes.groupBy("rid").agg(F.max_by("g", F.struct("votes", "high", "g")).alias("g")).filter("rid <> g"), "chosen")
    discard(top)
    return chosen


def members(sets: DataFrame, routes: DataFrame, least: int = 30) -> DataFrame:
    """(rid, g, na, lost, own, delta) of the sets that are similar to their head by `least` per cent or more; written.

    delta is the difference to the head, sorted. Other sets are in no family. A head's set is dealt once for each SHARE members.
    """
    chosen = heads(routes)
    sizes = written(chosen.groupBy("g").agg(F.ceil(F.count("*") / SHARE).alias("shares")), "sizes")
    of_head = sizes.join(sets.select(F.col("rid").alias("g"), F.col("shingles").alias("head")), "g").select("g", F.explode(F.sequence(F.lit(0), (F.col("shares") - 1).cast("int"))).alias("share"), "head")
    dealt = chosen.join(sizes, "g").select("rid", "g", F.pmod(F.xxhash64("rid"), "shares").cast("int").alias("share"))
    joined = dealt.join(sets.select("rid", "shingles"), "rid").join(of_head, ["g", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, gs = batch.column("rid").to_pylist(), batch.column("g").to_pylist()
            for i in range(batch.num_rows):
                x, a = batch.column("shingles")[i].values.to_numpy(), batch.column("head")[i].values.to_numpy()
                common = overlap(x, a)
                if 100 * common >= least * (len(x) + len(a) - common):
                    rows.append((ids[i], gs[i], len(a), len(a) - common, len(x) - common, np.setxor1d(x, a, assume_unique=True)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rid", "g", "na", "lost", "own", "delta"])

    found = written(joined.select("rid", "g", "shingles", "head").mapInArrow(run, "rid long, g long, na long, lost long, own long, delta array<long>"), "members")
    discard(chosen)
    discard(sizes)
    return found


def _up(x: Column, by: int) -> Column:
    return F.ceil(x / by)


def _weight(percent: int) -> Column:
    return 100 * F.col("lost") + percent * F.col("own")


def links(sets: DataFrame, routes: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rids: links that connect all that any links connect.

    `sets` is (rid, n, shingles), sorted and without repetitions; `routes` is (rid, round, token, score); `index` is (h, rid, n, behind):
    two linked sets have an entry h in common, behind which they have at most `behind` elements.
    """
    family = members(sets, routes)
    asked, places = _differences(family, percent)
    to_head = family.filter(_weight(percent) <= (100 - percent) * F.col("na")).select(F.col("rid").alias("a"), F.col("g").alias("b"))
    found = written(to_head.unionByName(_verified(_with_closest(places, percent), asked, percent)), "to-heads")
    merged = _merged(found)
    found = written(found.unionByName(_verified(_with_extremes(_labelled(places, merged), percent), asked, percent)), "to-components")
    merged = _merged(found)
    within = written(_verified(_within(_labelled(places, merged), percent), asked, percent), "within")
    for used in (asked, places):
        discard(used)
    labelled = _labelled(index, merged).join(family.select("rid", "g"), "rid", "left").withColumn("g", F.coalesce("g", "rid"))
    across = written(links_across(labelled, sets, percent), "across")
    for used in (family, merged):
        discard(used)
    return found.unionByName(across).unionByName(within)


def _merged(found: DataFrame) -> DataFrame:
    return written(components(found).select(F.col("id").alias("rid"), F.col("component_id").alias("c")), "merged")


def _labelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    return rows.join(merged, "rid", "left").withColumn("c", F.coalesce("c", "rid"))


def _differences(family: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(asked, index) of the families of which a member is apart from the head: asked has the members with w, e and delta; index has
    the entries (g, h, rid, w, e, behind) of their prefixes, as long as any partner (to_any) or a member that is linked with the head (to_linked) needs."""
    p = percent
    w = _weight(p)
    rows = family.select("rid", "g", w.alias("w"), (w - (100 - p) * F.col("na")).alias("e"), "delta")
    apart = written(rows.filter("e > 0").groupBy("g").agg(F.min("e").alias("least")), "apart")
    asked = rows.join(apart, "g").withColumn("need", _up(F.col("least") + F.col("w"), 100 + p))
    asked = asked.withColumn("need", F.when(F.col("e") > 0, F.least("need", _up(F.col("e"), 100))).otherwise(F.col("need")))
    asked = written(asked.filter(F.col("need") <= F.size("delta")), "asked")
    discard(apart)

    items = asked.select("rid", "g", "w", "e", "least", "need", F.size("delta").alias("d"), F.explode("delta").alias("h"))
    often = items.groupBy("g", "h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = items.join(often, ["g", "h"])
    found = F.count("*").over(Window.partitionBy("rid"))
    # differences that no other member has would come first, so the others' places begin behind them
    place = F.row_number().over(Window.partitionBy("rid").orderBy("df", "h")) + F.col("d") - F.col("found")
    shared = shared.withColumn("found", found).filter("found >= need").withColumn("behind", F.col("d") - place)
    to_any = F.col("behind") >= _up(F.col("least") + F.col("w"), 100 + p) - 1
    to_linked = (F.col("e") > 0) & (F.col("behind") >= _up(F.col("e"), 100) - 1)
    index = shared.select("g", "h", "rid", "w", "e", "behind", to_any.alias("to_any"), to_linked.alias("to_linked"))
    return asked, written(index.filter("to_any or to_linked"), "differences")


def _may_link(percent: int) -> Column:
    """Whether entries x (apart from the head) and y (within its prefix for any partner) can be of linked sets."""
    both = (F.col("y.e") > 0) & F.col("x.to_any")
    one = (F.col("y.e") <= 0) & F.col("x.to_linked")
    reach = (F.least("x.behind", "y.behind") + 1) * (100 + percent) >= F.col("x.e") + F.col("y.w")
    return (F.col("x.rid") != F.col("y.rid")) & (both | one) & reach


def _with_closest(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): each entry of a list with that of the member closest to the head."""
    of_list = index.filter("to_any").groupBy("g", "h").agg(F.min(F.struct("w", "rid", "e", "behind")).alias("y"))
    met = index.filter("e > 0").alias("x").join(of_list.alias("o"), (F.col("x.g") == F.col("o.g")) & (F.col("x.h") == F.col("o.h"))).select("x.*", F.col("o.y").alias("y"))
    x = F.struct("rid", "e", "behind", "to_any", "to_linked").alias("x")
    return met.select(x, "y").filter(_may_link(percent)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def _with_extremes(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): each entry of a list with those of the members of the lowest and the highest component."""
    entry = F.struct("c", "w", "rid", "e", "behind")
    of_list = index.filter("to_any").groupBy("g", "h").agg(F.min(entry).alias("low"), F.max(entry).alias("high")).filter("low.c < high.c")
    met = index.filter("e > 0").alias("x").join(of_list.alias("o"), (F.col("x.g") == F.col("o.g")) & (F.col("x.h") == F.col("o.h")))
    x = F.struct("rid", "e", "behind", "to_any", "to_linked", "c").alias("x")
    met = met.select("x.*", F.explode(F.array("o.low", "o.high")).alias("y")).select(x, "y")
    return met.filter((F.col("x.c") != F.col("y.c")) & _may_link(percent)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def _within(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): entries of one list that lie in different components."""
    x, y = index.filter("e > 0").alias("x"), index.filter("to_any").alias("y")
    once = (F.col("y.e") <= 0) | (F.col("x.rid") < F.col("y.rid"))
    apart = (F.col("x.g") == F.col("y.g")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c"))
    return x.join(y, apart & once & _may_link(percent)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def _verified(pairs: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by what their differences have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            shared = np.array([overlap(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)], np.int64)
            linked = (100 + percent) * shared >= batch.column("e").to_numpy() + batch.column("w").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    left = asked.select(F.col("rid").alias("a"), "e", F.col("delta").alias("x"))
    right = asked.select(F.col("rid").alias("b"), "w", F.col("delta").alias("y"))
    met = written(pairs, "difference-pairs").join(left, "a").join(right, "b")
    return met.select("a", "b", "e", "w", "x", "y").mapInArrow(run, "a long, b long")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) of rids with both sizes and the overlap, the sets side by side in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            found = [overlap(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(found, pa.int64())], names=["a", "b", "na", "nb", "common"])

    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na long, nb long, common long")


def _linked(common: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * common >= percent * (na + nb - common)


def blocks_of(index: DataFrame) -> DataFrame:
    """The lists of (h, rid, n, behind, g, c) that entries of different families and components share, in blocks."""
    several = (F.min("g") < F.max("g")) & (F.min("c") < F.max("c"))
    lists = index.groupBy("h").agg(several.alias("several"), F.ceil(F.count("*") / BLOCK_ENTRIES).alias("parts")).filter("several")
    entry = index.join(lists.select("h", "parts"), "h")
    # a block holds like positions, and the entries of a long list are dealt evenly over as many parts as it needs
    block = F.when(F.col("parts") > 1, F.floor(F.log2(F.col("behind") + 1)) * 1_000_000_007 + F.pmod(F.xxhash64("rid"), "parts")).otherwise(0)
    return entry.groupBy("h", block.alias("block")).agg(
        F.min("n").alias("small"), F.max("n").alias("large"), F.max("behind").alias("behind"), F.min("g").alias("low"), F.max("g").alias("high"), F.min("c").alias("low_c"), F.max("c").alias("high_c"),
        F.collect_list(F.struct("rid", "n", "behind", "g", "c")).alias("entries"),
    )


def pairs_across(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rids of different families and components that share an entry of the index and may reach the overlap; pairs may be repeated."""
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = (100 * F.col("x.large") >= percent * F.col("y.small")) & (100 * F.col("y.large") >= percent * F.col("x.small"))
    reach = (F.least("x.behind", "y.behind") + 1) * (100 + percent) >= percent * (F.col("x.small") + F.col("y.small"))
    other = F.lit(True)
    for c in ("", "_c"):
        other = other & ((F.col(f"x.low{c}") < F.col(f"x.high{c}")) | (F.col(f"y.low{c}") < F.col(f"y.high{c}")) | (F.col(f"x.low{c}") != F.col(f"y.low{c}")))
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.block") <= F.col("y.block")) & sizes & reach & other)
    one = met.select(F.explode("x.entries").alias("p"), F.col("y.entries").alias("others"), (F.col("x.block") == F.col("y.block")).alias("same"))
    p = F.col("p")

    def fits(q: Column) -> Column:
        apart = (p["g"] != q["g"]) & (p["c"] != q["c"]) & (~F.col("same") | (p["rid"] < q["rid"]))
        size = 100 * F.least(p["n"], q["n"]) >= percent * F.greatest(p["n"], q["n"])
        return apart & size & ((F.least(p["behind"], q["behind"]) + 1) * (100 + percent) >= percent * (p["n"] + q["n"]))

    pairs = one.select(p["rid"].alias("one"), F.explode(F.transform(F.filter("others", fits), lambda q: q["rid"])).alias("other"))
    return pairs.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))


def links_across(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rids of different families and components that share an entry of the index (h, rid, n, behind, g, c) and are linked."""
    blocks = written(blocks_of(index), "blocks")
    pairs = written(pairs_across(blocks, percent).distinct(), "pairs-across")
    compared = _overlaps(pairs, sets).filter(_linked(F.col("common"), F.col("na"), F.col("nb"), percent))
    return compared.select("a", "b")
