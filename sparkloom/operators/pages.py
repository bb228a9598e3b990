"""Tables of pages: which pages begin, continue or leave off a table, and pages put together where a table goes on.

A merged page can't begin the next pair. Of neighbouring pages that would all go together, every second one therefore joins the
one before it: its place within such a run decides, and no page waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import ordered
from sparkloom.operators.references import trimmed
from sparkloom.sources.shared import written_once

#: The line under a table's head (fixed value).
RULE = r"(?U)^\|[\s\-:]+\|"


def lines(c: str | Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(T.text(c), "\n"), trimmed), lambda x: x != "")


def bars(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def _same(counts: Column) -> Column:
    """All of some numbers of bars are equal and 2 at least."""
    return (F.size(F.array_distinct(counts)) == 1) & (F.get(counts, F.lit(0)) >= 2)


def _with_bars(c: str | Column, said: Column) -> Column:
    """What is said of a text with a bar; false of one without, whose lines needn't be told apart."""
    return F.when(T.text(c).contains("|"), said).otherwise(False)


def starts_table(c: str | Column) -> Column:
    """Two lines or more, of which the second rules off the first, or the first three have equally many bars."""
    found = lines(c)
    headed = F.get(found, F.lit(0)).contains("|") & F.get(found, F.lit(1)).rlike(RULE)
    return _with_bars(c, F.when(F.size(found) >= 2, headed | _same(F.transform(F.slice(found, 1, 3), bars))).otherwise(False))


def continues_table(c: str | Column) -> Column:
    """Of the first five lines two or more have bars, all equally many, and the second line of the page rules nothing off."""
    found = lines(c)
    rows = F.filter(F.slice(found, 1, 5), lambda x: x.contains("|"))
    return _with_bars(c, F.when(F.size(rows) >= 2, _same(F.transform(rows, bars)) & ~F.get(found, F.lit(1)).rlike(RULE)).otherwise(False))


def leaves_table_off(c: str | Column) -> Column:
    """Of three lines or more the last has a bar, and so have two or more of the last five and half of them (rounded down)."""
    found = lines(c)
    n = F.size(found)
    end = F.slice(found, F.greatest(F.lit(1), n - 4), 5)
    rows = F.size(F.filter(end, lambda x: x.contains("|")))
    return _with_bars(c, F.when(n >= 3, (rows >= 2) & (rows >= F.floor(F.size(end) / 2)) & F.get(found, n - 1).contains("|")).otherwise(False))


def has_head(c: str | Column) -> Column:
    """Whether the first lines with bars end in a rule: a line with a bar before it, and from the first of them on only such lines."""
    at = F.transform(F.split(T.text(c), "\n"), lambda x: F.struct(x.contains("|").alias("bar"), trimmed(x).rlike(RULE).alias("rule")))
    first = F.array_position(F.transform(at, lambda x: x["bar"]), True)
    rest = F.slice(at, F.greatest(first, F.lit(1)).cast("int"), F.size(at))
    gap = F.array_position(F.transform(rest, lambda x: x["bar"]), False)
    run = F.when(gap > 0, F.slice(rest, F.lit(1), gap.cast("int"))).otherwise(rest)  # the line after the last bar may be the rule
    return _with_bars(c, F.when(first > 0, F.exists(F.slice(run, F.lit(2), F.greatest(F.size(run) - 1, F.lit(0))), lambda x: x["rule"])).otherwise(False))


def _told_apart(pages: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, order, text, _tie): pages of one place are numbered in the order of their text. Where each page has a place of its own, as it should, no text is moved."""
    rows = pages.select(by, order, T.text(text).alias("text"))
    if rows.groupBy(by, order).count().filter("count > 1").isEmpty():
        return rows.withColumn("_tie", F.lit(1))
    return rows.withColumn("_tie", F.row_number().over(Window.partitionBy(by, order).orderBy("text")))


def _same_page(left: str, right: str, names: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in names:
        out = out & F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{b}"))
    return out


def merged(pages: DataFrame, by: str, order: str, text: str, opens: Column, continues: Column, block: Column, put: Column | None = None) -> DataFrame:
    """(by, order, text, pages): pages of a document in order, those that go on as a table with the next one appended to them.

    A page goes together with its next where `opens` holds for the one and `continues` for the other (both of column `text`); `put` says
    what they are together (of columns `text` and `next`; by default both, a line each). Pages of one place are ordered by their text. The
    last page goes on in none.

    Only places and these two answers are put in order, and only texts of pages for which one of them holds are moved to their pair.
    """
    rows = _told_apart(pages, by, order, text).withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_continues": F.coalesce(continues, F.lit(False))})
    asked = written_once(rows.select(F.col(by).alias("by"), F.col(order).alias("order"), "_tie", "_opens", "_continues", block.alias("_block")), "pages")
    numbered = ordered.numbered(asked, ["by"], ["order", "_tie"], F.col("_block"), "_p")
    after = numbered.select(F.col("by").alias("_by"), (F.col("_p") - 1).alias("_q"), F.col("_continues").alias("_goes"), F.col("order").alias("_next"), F.col("_tie").alias("_next_tie"))
    pairs = numbered.join(after, F.col("by").eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")), "left").drop("_by", "_q")
    pairs = pairs.withColumn("_on", F.col("_opens") & F.coalesce("_goes", F.lit(False)))
    runs = ordered.carried(pairs, ["by"], ["_p"], F.floor(F.col("_p") / 4096), F.when(~F.col("_on"), F.col("_p")), "_stop", with_own=False)
    before = F.col("_p") - 1 - F.coalesce("_stop", F.lit(0))  # pages that go on, just before this one
    firsts = written_once(runs.filter(F.col("_on") & (before % 2 == 0)).select("by", "order", "_tie", "_next", "_next_tie"), "page-pairs")
    seconds = firsts.select("by", F.col("_next").alias("order"), F.col("_next_tie").alias("_tie"), F.col("order").alias("first"), F.col("_tie").alias("first_tie"))

    may = F.col("_opens") | F.col("_continues")
    still = rows.filter(~may).select(by, order, F.col("text").alias(text), F.lit(1).alias("pages"))
    moved = rows.filter(may).alias("r").join(seconds.alias("s"), _same_page("r", "s", [(by, "by"), (order, "order"), ("_tie", "_tie")]), "left")
    second = F.col("s._tie").isNotNull()
    place = {"by": F.col(f"r.{by}"), "order": F.when(second, F.col("s.first")).otherwise(F.col(f"r.{order}")), "_tie": F.when(second, F.col("s.first_tie")).otherwise(F.col("r._tie"))}
    each = moved.select(*[c.alias(n) for n, c in place.items()], F.when(~second, F.col("r.text")).alias("text"), F.when(second, F.col("r.text")).alias("next"))
    told = each.groupBy("by", "order", "_tie").agg(F.max("text").alias("text"), F.max("next").alias("next"))
    both = put if put is not None else F.concat("text", F.lit("\n"), F.col("next"))
    paired = F.col("next").isNotNull()
    told = told.select(F.col("by").alias(by), F.col("order").alias(order), F.when(paired, both).otherwise(F.col("text")).alias(text), F.when(paired, 2).otherwise(1).alias("pages"))
    return still.unionByName(written_once(told, "told-pages"))


def with_whole_tables(pages: DataFrame, by: str, order: str, text: str, block: Column) -> DataFrame:
    """Pages that leave a table off, with the next where that continues one."""
    return merged(pages, by, order, text, leaves_table_off("text"), continues_table("text"), block)


def with_joined_tables(pages: DataFrame, by: str, order: str, text: str, block: Column) -> DataFrame:
    """Pages with any bar, with the next where that continues a table; behind a table's head only the next page's rows are put."""
    rows = F.array_join(F.filter(F.split("next", "\n"), lambda x: x.contains("|")), "\n")
    put = F.concat("text", F.lit("\n"), F.when(has_head("text"), rows).otherwise(F.col("next")))
    return merged(pages, by, order, text, starts_table("text") | F.col("text").contains("|"), continues_table("text"), block, put)
