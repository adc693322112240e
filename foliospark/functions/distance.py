"""Edit distances and vector similarity as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Own confusion costs in tenths, symmetric: letters that scans mix up.
CONFUSION_TENTHS = [
    ("i", "l", 1),
    ("o", "ö", 1),
    ("u", "ü", 1),
    ("a", "ä", 1),
    ("e", "é", 1),
    ("e", "è", 1),
    ("n", "ñ", 1),
    ("c", "ç", 1),
    ("l", "t", 2),
    ("r", "n", 2),
    ("c", "e", 2),
    ("o", "e", 2),
    ("i", "j", 2),
    ("u", "v", 2),
    ("ï", "i", 2),
    ("e", "ê", 2),
    ("i", "í", 2),
    ("o", "ó", 2),
    ("a", "o", 2),
    ("f", "t", 3),
    ("h", "b", 3),
    ("g", "q", 3),
    ("m", "n", 3),
    ("v", "y", 3),
    ("s", "z", 3),
    ("k", "i", 3),
    ("b", "d", 4),
    ("p", "q", 4),
    ("x", "k", 4),
]


def confusion_pairs() -> list[tuple[str, str, int]]:
    """(a, b, cost in tenths) in both directions."""
    return [row for a, b, cost in CONFUSION_TENTHS for row in ((a, b, cost), (b, a, cost))]


def confusion_map(pairs: list[tuple[str, str, int]]) -> Column:
    return F.create_map(*[F.lit(x) for a, b, cost in pairs for x in (a + b, cost)])


def confusion_cost(a: Column, b: Column, costs: Column) -> Column:
    """Tenths of substituting b for a: 0 if equal but for case, null if not listed."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(F.try_element_at(costs, F.concat(a, b)), F.try_element_at(costs, F.concat(b, a))))


def weighted_levenshtein(a: Column, b: Column, costs: Column) -> Column:
    """Tenths of the cheapest edits from a to b: insertion and deletion 10, substitution by confusion cost or 10.

    Whole tenths keep comparisons exact.  An empty operand costs the other's length.  The cost is that
    of a table of length(a) by length(b) in whole-row steps, so call it on pairs that passed a filter
    on the difference in length, the only safe lower bound.
    """
    x, y = F.filter(F.split(F.lower(a), ""), lambda c: c != ""), F.filter(F.split(F.lower(b), ""), lambda c: c != "")
    first = F.transform(F.sequence(F.lit(0), F.size(y)), lambda j: j * 10)

    def row(prev: Column, c: Column) -> Column:
        start = F.array(prev[0] + 10)

        def cell(out: Column, j: Column) -> Column:
            d = F.element_at(y, j + 1)
            sub = F.when(c == d, 0).otherwise(F.coalesce(F.try_element_at(costs, F.concat(c, d)), F.lit(10)))
            best = F.least(F.element_at(out, -1) + 10, F.element_at(prev, j + 2) + 10, F.element_at(prev, j + 1) + sub)
            return F.array_append(out, best)

        steps = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, cell)

    return F.element_at(F.aggregate(x, first, row), -1)


def weighted_tenths(a: str, b: str, costs: dict[tuple[str, str], int]) -> int:
    """weighted_levenshtein of two strings, for code that runs in Python."""
    a, b = a.lower(), b.lower()
    prev = [10 * j for j in range(len(b) + 1)]
    for c in a:
        row = [prev[0] + 10]
        for j, d in enumerate(b):
            row.append(min(row[-1] + 10, prev[j + 1] + 10, prev[j] + (0 if c == d else costs.get((c, d), 10))))
        prev = row
    return prev[-1]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths, empty arrays and zero norms."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (na == 0) | (nb == 0), zero).otherwise(dot / (na * nb))
