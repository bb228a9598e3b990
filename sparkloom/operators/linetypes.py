"""Typed blocks of the lines of a text: titles, list items, table rows, code and paragraphs.

What a line is by itself is a column expression. Whether it begins a block or is taken up by the one before depends on the block
that is open, so the lines' kinds go through a machine of three states (none, paragraph, code); the rest is grouping by block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.operators.references import SPACE, trimmed

# --- Fixed values: what begins a title, a list item, a table row; signs of code; marks that no space follows ---
TITLES = [r"^[A-Z\s]{3,30}$", r"^第[一二三四五六七八九十\d]+[章节部分]", r"(?i)^Chapter\s+\d+", r"^\d+\.\s*[A-Z]"]
SHORT_TITLE = r"^\d+\.?\s+[A-Z]"
ITEMS = [
    r"^[\s]*[•·●○■□▪▫]\s+",
    r"^[\s]*[\d]+[.、)]\s+",
    r"^[\s]*[a-zA-Z][.、)]\s+",
    r"^[\s]*[(（][一二三四五六七八九十\d]+[)）]\s+",
    r"^[\s]*[一二三四五六七八九十]+[、]\s*",
]
ROWS = [r"[|｜]\s*.+\s*[|｜]", r"\t.+\t"]
CODE = r"[{}();=<>\[\]]"
JOINED_BEHIND = "。，、；：！？\"\"（）【】《》"
HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# --- end of fixed values ---

KINDS = ["blank", "title", "list_item", "table_row", "code", "paragraph"]


def _any(line: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | line.rlike("(?U)" + p)
    return found


def is_title(line: Column) -> Column:
    n = F.length(line)
    upper = line.rlike(r"\p{IsUppercase}") & ~line.rlike(r"[\p{IsLowercase}\p{Lt}]")
    return (n > 0) & (n <= 100) & (_any(line, TITLES) | ((n < 50) & (upper | _any(line, [SHORT_TITLE]))))


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, f"(?U)^{SPACE}+", ""))


def is_code(line: Column) -> Column:
    """Set in by four or more, with a sign of code."""
    return (indent(line) >= 4) & line.rlike(CODE)


def level(title: Column) -> Column:
    """1 to 6 of a title: marks #, chapters, sections, numbers, else by length."""
    marks = F.length(title) - F.length(F.replace(title, F.lit("#"), F.lit("")))
    numbered = F.when(title.rlike(r"(?U)^\d+\.\s"), 2).when(title.rlike(r"(?U)^\d+\.\d+\.\s"), 3)
    chinese = F.when(title.rlike("^第[一二三四五六七八九十]章"), 1).when(title.rlike("^第[一二三四五六七八九十]节"), 2)
    return F.when(title.startswith("#"), F.least(F.lit(6), marks)).otherwise(F.coalesce(chinese, numbered, F.when(F.length(title) < 30, 1).otherwise(2)))


def kind(line: Column) -> Column:
    """The place of a line's own kind in `KINDS`, and 8 more if it could go on in a block of code."""

    def of(x: Column) -> Column:
        own, end, code = x["own"], x["end"], x["code"]
        base = F.when(own == "", 0).when(is_title(own), 1).when(_any(end, ITEMS), 2).when(_any(end, ROWS), 3).when(x["code_end"], 4).otherwise(5)
        return base + F.when((own != "") & code, 8).otherwise(0)

    end = F.regexp_replace(line, f"(?U){SPACE}+$", "")
    cut = F.struct(trimmed(line).alias("own"), end.alias("end"), is_code(line).alias("code"))
    return X.let(X.let(cut, lambda x: F.struct(x["own"].alias("own"), x["end"].alias("end"), x["code"].alias("code"), is_code(x["end"]).alias("code_end"))), of)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _blocks(kinds: pd.Series) -> pd.Series:
    """The block of each line, from 0 on; -1 for blank lines. Code takes up lines that could be code, a paragraph code and plain lines."""

    def one(row) -> list[int]:
        out, block, state = [], -1, None
        for k in row:
            base, codelike = k & 7, k & 8
            if state == "code" and codelike:
                out.append(block)
                continue
            if base == 0:
                state = None
                out.append(-1)
                continue
            if not (state == "paragraph" and base >= 4):
                block += 1
                state = {4: "code", 5: "paragraph"}.get(base)
            out.append(block)
        return out

    return kinds.map(one)


def typed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, block, type, level, content): the blocks of each text in order.

    Lines of a paragraph are joined with a space behind a letter or digit and without one behind ideographs and marks; a list item has
    no bullet, and half its indent as its level. Rows that share an id are texts of one number, so give each its own.
    """
    lines = F.split(X.text(text_col), LINE_END)
    marked = X.let(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, kind).alias("kinds")))
    kinds = docs.select(F.col(id_col).alias("doc"), marked.alias("m")).withColumn("blocks", _blocks("m.kinds")).select("doc", "m.lines", "m.kinds", "blocks")
    rows = kinds.select("doc", F.posexplode(F.arrays_zip("lines", "blocks", "kinds")).alias("at", "x")).filter("x.blocks >= 0")
    rows = rows.select("doc", F.col("x.blocks").alias("block"), "at", F.col("x.lines").alias("line"), F.col("x.kinds").bitwiseAND(7).alias("kind"))
    grouped = rows.groupBy("doc", "block").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "line"))).alias("l"))
    first = F.get("l", F.lit(0))
    own = trimmed(first["line"])

    def put(x: Column) -> Column:
        def spaced(word: Column) -> Column:
            last = F.right(word, F.lit(1))
            glued = last.rlike(HAN) | F.lit(JOINED_BEHIND).contains(last) | ~last.rlike(r"[\p{L}\p{N}]")
            return F.concat(word, F.when(glued, "").otherwise(" "))

        return X.let(trimmed(x["line"]), spaced)

    paragraph = F.concat(F.array_join(F.transform(F.slice(F.col("l"), F.lit(1), F.size("l") - 1), put), ""), trimmed(F.element_at("l", -1)["line"]))
    bare = own
    for p in reversed(ITEMS):
        bare = F.when(own.rlike("(?U)" + p), trimmed(F.regexp_replace(own, "(?U)" + p, ""))).otherwise(bare)
    after = F.transform(F.slice(F.col("l"), F.lit(2), F.size("l")), lambda x: x["line"])
    code = F.array_join(F.concat(F.array(F.regexp_replace(first["line"], f"(?U){SPACE}+$", "")), after), "\n")
    names = F.element_at(F.array(*map(F.lit, KINDS)), first["kind"] + 1)
    content = F.when(first["kind"] == 2, bare).when(first["kind"] == 4, code).when(first["kind"] == 5, paragraph).otherwise(own)
    levels = F.when(first["kind"] == 1, level(own)).when(first["kind"] == 2, F.floor(indent(first["line"]) / 2)).otherwise(0)
    return grouped.select("doc", "block", names.alias("type"), levels.cast("int").alias("level"), content.alias("content"))
