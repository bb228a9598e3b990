"""Formulas in texts: where they are, what they say in words, and which variables they relate. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# --- Fixed values: what a formula looks like; LaTeX in words, in the order in which it is replaced; operators in words ---
FORMULAS = [
    ("latex_inline", r"\$([^\$]+)\$"),
    ("latex_display", r"\$\$([^\$]+)\$\$"),
    ("equation", r"\b([A-Z])\s*=\s*([^\s,;.]+(?:\s*[+\-*/^]\s*[^\s,;.]+)*)\b"),
]
LATEX = [
    (r"\\frac\{([^}]+)\}\{([^}]+)\}", "$1 divided by $2"),
    (r"\\sqrt\{([^}]+)\}", "square root of $1"),
    (r"\\sum", "sum"),
    (r"\\int", "integral"),
    (r"\\alpha", "alpha"),
    (r"\\beta", "beta"),
    (r"\\gamma", "gamma"),
    (r"\\delta", "delta"),
    (r"\\pi", "pi"),
    (r"\\theta", "theta"),
    (r"\^2", " squared"),
    (r"\^3", " cubed"),
    (r"\^", " to the power of "),
    (r"_", " subscript "),
]
OPERATORS = [("^2", " squared"), ("^3", " cubed"), ("^", " to the power of "), ("*", " times "), ("/", " divided by "), ("+", " plus "), ("-", " minus ")]
FUNCTIONS = r"(?i)\b(?:sin|cos|tan|log|ln|exp|sqrt)\b"
# --- end of fixed values ---

VARIABLE = r"(?U)\b[a-zA-Z]\b"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def formulas(c: str | Column) -> Column:
    """All formulas as (type, position, raw, formula): the kinds after one another, each in the order of the text. Kinds may overlap."""
    text = T.text(c)

    def of(name: str, pattern: str) -> Column:
        p = f"(?U){pattern}"
        raw = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        inner = raw if name == "equation" else F.regexp_extract_all(text, F.lit(p), F.lit(1))
        pieces = F.split(text, p, -1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        ahead = F.zip_with(pieces, raw, lambda x, r: F.struct(F.length(x).alias("before"), F.length(r).alias("own")))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + x["before"]
            return F.struct((at + F.coalesce(x["own"], F.lit(0))).alias("at"), F.concat(s["found"], F.array(at)).alias("found"))

        places = F.aggregate(ahead, zero, step)["found"]
        return F.transform(raw, lambda r, i: F.struct(F.lit(name).alias("type"), F.get(places, i).alias("position"), r.alias("raw"), F.get(inner, i).alias("formula")))

    return F.concat(*[of(n, p) for n, p in FORMULAS])


def in_words(kind: Column, formula: Column) -> Column:
    """A formula in words; an equation with more or fewer than two sides stays as it is."""
    latex = formula
    for p, put in LATEX:
        latex = F.regexp_replace(latex, p, put)
    latex = _trim(F.regexp_replace(F.regexp_replace(latex, r"\\[a-zA-Z]+", ""), r"[{}]", ""))
    sides = F.split(formula, "=")
    right = _trim(F.get(sides, F.lit(1)))
    for sign, word in OPERATORS:
        right = F.replace(right, F.lit(sign), F.lit(word))
    equation = F.when(F.size(sides) == 2, F.concat(_trim(F.get(sides, F.lit(0))), F.lit(" equals "), right)).otherwise(formula)
    return F.when(kind == "equation", equation).otherwise(latex)


def parts(formula: Column) -> dict[str, Column]:
    """Distinct variables (single letters), operators, numbers and functions, in order of spelling."""
    found = {"variables": VARIABLE, "operators": r"[+\-*/^=]", "constants": r"(?U)\b\d+\.?\d*\b", "functions": "(?U)" + FUNCTIONS}
    return {n: F.array_sort(F.array_distinct(T.matches(formula, p))) for n, p in found.items()}


def explained(c: str | Column) -> Column:
    """The text with a formula's words in brackets behind it, the last formula first; of equal formulas the first one gets them."""
    text = T.text(c)
    later = F.transform(formulas(c), lambda f, i: F.struct((-f["position"]).alias("p"), i.alias("i"), f["raw"].alias("raw"), in_words(f["type"], f["formula"]).alias("said")))

    def step(t: Column, f: Column) -> Column:
        at = F.instr(t, f["raw"])
        end = at + F.length(f["raw"])
        return F.when(at > 0, F.concat(F.substr(t, F.lit(1), end - 1), F.lit(" ["), f["said"], F.lit("]"), F.substr(t, end))).otherwise(t)

    return F.aggregate(F.array_sort(later), text, step)


def relations(formula: Column) -> Column:
    """(head, relation, tail) of a formula with two sides: EQUALS from each variable of the left to each of the right; with a product or a
    quotient on the right DEPENDS_ON from the left side to each variable of the right."""
    sides = F.split(formula, "=")
    left, right = (_trim(F.coalesce(F.get(sides, F.lit(i)), F.lit(""))) for i in (0, 1))
    heads, tails = T.matches(left, VARIABLE), T.matches(right, VARIABLE)

    def edge(head: Column, name: str, tail: Column) -> Column:
        return F.struct(head.alias("head"), F.lit(name).alias("relation"), tail.alias("tail"))

    equal = F.flatten(F.transform(heads, lambda h: F.transform(tails, lambda t: edge(h, "EQUALS", t))))
    bound = F.when(right.rlike(r"[*/]"), F.transform(tails, lambda t: edge(left, "DEPENDS_ON", t))).otherwise(F.slice(F.transform(tails, lambda t: edge(left, "DEPENDS_ON", t)), 1, 0))
    return F.when(F.size(sides) == 2, F.concat(equal, bound)).otherwise(F.slice(equal, 1, 0))
