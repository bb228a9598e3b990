"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good, votes bad or abstains. How far a rule can be trusted is not set by
hand: a two-class latent model gives each rule its own chance of each vote among good and among bad texts, and
expectation-maximisation estimates them, and the share of good texts, from the votes of the whole corpus. A text is kept if
its posterior probability of being good is high enough. A hard minimum (length, repetition) stands beside the model.

All work on texts is DataFrame functions on one row at a time. The model sees only how often each pattern of votes occurs: at
most 3 ** rules rows, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Common short words of English, German, French and Spanish: running text has many, lists and noise have few.
COMMON = ("the of and to in is that for it as with by on are this be der die das und von zu den mit ist im nicht auf ein de la le les et des un une est que en du pour dans el los y del se por con las para").split()
GOOD, ABSTAIN, BAD = 1, 0, -1
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The row as `row` (a struct, so no name can clash) and its counts; a null text counts as one without words.

    n_repeat_words: words that lie in a window of three words that occurs twice or more in the text. Windows are compared by
    64-bit hashes (xxhash64 over the three words): a text of 20,000 words has a chance of 1e-11 of one false match.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    start = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("_text"))
    counted = start.select(
        "row",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.regexp_replace(text, "!", ""))).cast("long").alias("n_shouts"),
    )
    w = F.col("_w")
    hashed = counted.select(
        "row", "word_chars", "n_symbols", "n_upper", "n_shouts",
        F.size(w).cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.isin(COMMON))).cast("long").alias("n_common"),
        F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias("_h"),
    )
    kept = [c for c in hashed.columns if c != "_h"]
    h, s, d = F.col("_h"), F.col("_s"), F.col("_d")
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    ordered = hashed.select(*kept, F.when(repeats, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    again = F.filter(
        F.transform(s, lambda x, i: F.when((F.when(i > 0, F.get(s, i - 1)["h"]) == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])),
        lambda x: x.isNotNull(),
    )
    places = ordered.select(*kept, F.array_sort(again).alias("_d"))
    covered = F.aggregate(F.transform(d, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(d, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return places.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int")


def rules() -> dict[str, Column]:
    """The votes, as expressions over the counts of `measured`."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    symbols, upper, shouts, common = F.col("n_symbols"), F.col("n_upper"), F.col("n_shouts"), F.col("n_common")
    repeated, dup = F.col("n_repeat_words"), F.col("n_dup_lines")
    return {
        "symbols": _vote(200 * symbols < chars, 20 * symbols > chars),
        "capitals": _vote(8 * upper < chars, 3 * upper > chars),
        "shouting": _vote(50 * shouts < n, 8 * shouts > n),
        "common_words": _vote(12 * common > n, 30 * common < n),
        "repetition": _vote(20 * repeated < n, 4 * repeated > n),
        "repeated_lines": _vote((lines > 1) & (dup == 0), 4 * dup > lines),
        "word_length": _vote((2 * chars > 5 * n) & (chars < 9 * n), (chars > 14 * n) | (chars < 2 * n)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class VoteModel:
    """good: share of good texts; chances[rule][y][vote + 1]: the chance of a vote among bad (y = 0) and good (y = 1) texts."""

    names: list[str]
    good: float
    chances: list[list[list[float]]]

    @classmethod
    def fit(cls, names: list[str], patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
        """EM over (votes, how often). The start takes a text with any bad vote for bad; counts are smoothed by one text a cell."""
        p = [0.1 if BAD in votes else 0.95 for votes, _ in patterns]
        total = sum(n for _, n in patterns)
        before, model = -math.inf, cls(names, 0.9, [[[0.4, 0.3, 0.3], [0.02, 0.3, 0.68]] for _ in names])
        if not total:
            return model
        for _ in range(rounds):
            mass = [1.0 + sum(n * (1 - q) for (_, n), q in zip(patterns, p, strict=True)), 1.0 + sum(n * q for (_, n), q in zip(patterns, p, strict=True))]
            chances = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in names]
            for (votes, n), q in zip(patterns, p, strict=True):
                for j, v in enumerate(votes):
                    chances[j][0][v + 1] += n * (1 - q)
                    chances[j][1][v + 1] += n * q
            model = cls(names, mass[1] / sum(mass), [[[x / sum(row) for x in row] for row in rule] for rule in chances])
            scores = [model._logs(votes) for votes, _ in patterns]
            p = [1 / (1 + math.exp(min(700.0, b - g))) for b, g in scores]
            likelihood = sum(n * (max(s) + math.log1p(math.exp(-abs(s[0] - s[1])))) for (_, n), s in zip(patterns, scores, strict=True)) / total
            if likelihood - before < tolerance:
                break
            before = likelihood
        return model

    def _logs(self, votes: tuple[int, ...]) -> tuple[float, float]:
        b, g = math.log(1 - self.good), math.log(self.good)
        for j, v in enumerate(votes):
            b += math.log(self.chances[j][0][v + 1])
            g += math.log(self.chances[j][1][v + 1])
        return b, g

    def accuracies(self) -> dict[str, float]:
        """Of each rule: how often a vote that isn't an abstention is right."""
        out = {}
        for name, (bad, good) in zip(self.names, self.chances, strict=True):
            right = (1 - self.good) * bad[0] + self.good * good[2]
            out[name] = right / (right + (1 - self.good) * bad[2] + self.good * good[0])
        return out

    def posterior(self) -> Column:
        """Probability of a good text as an expression over the vote columns: the votes' log odds add up."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, (bad, good) in zip(self.names, self.chances, strict=True):
            w = [math.log(g / b) for b, g in zip(bad, good, strict=True)]
            odds = odds + F.when(F.col(f"vote_{name}") == BAD, w[0]).when(F.col(f"vote_{name}") == GOOD, w[2]).otherwise(w[1])
        return 1 / (1 + F.exp(-odds))


def _fitted(voted: DataFrame) -> VoteModel:
    names = list(rules())
    cols = [f"vote_{n}" for n in names]
    counted = voted.groupBy(*cols).count().collect()  # at most 3 ** rules rows
    return VoteModel.fit(names, sorted((tuple(r[c] for c in cols), r["count"]) for r in counted))


def judge(docs: DataFrame, *, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts, votes, base_failed, posterior, kept.

    Null and empty texts have no words and so fail the minimum. Repeated rows are judged alike, and count in the model each.
    Extra columns are not read. An empty table gives no rows.
    """
    counts = [*BASE, "n_lines", "n_upper", "n_shouts", "n_common"]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    voted = written(measured(rows).select("row.doc_id", *counts, *[v.alias(f"vote_{n}") for n, v in rules().items()]), "votes")
    posterior = _fitted(voted).posterior()
    out = voted.withColumns({"base_failed": base_failed(), "posterior": posterior})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def keep_good(docs: DataFrame, *, keep_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that `judge` keeps, with their own columns and no others."""
    votes = {f"vote_{n}": v for n, v in rules().items()}
    # the counts are written before the filter: pushed below them, it would repeat their expressions
    voted = written(measured(docs, text_col).select("row", base_failed().alias("base_failed"), *[v.alias(n) for n, v in votes.items()]), "votes")
    return voted.filter(~F.col("base_failed") & (_fitted(voted).posterior() >= keep_from)).select("row.*")
