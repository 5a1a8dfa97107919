"""Differences of two texts by a longest common subsequence of their lines, as data.

Ends that are equal are set aside. What is left is matched exactly: where few lines repeat, along the pairs of equal lines
(their number times a logarithm); where many do, by rows of bits (a 64th of the product of the lengths), halved as often
as needed so that no table of the whole is kept. A steps column holds what an editor would do: equal, replace, delete and
insert with their ranges on both sides.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = ("a_start", "a_stop", "b_start", "b_stop")
STEPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in PLACES)]))
#: Pairs of equal lines, in units of all lines, up to which the way along the pairs is taken. Both ways are exact.
PAIRS = 32


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence, by rows of bits."""
    return _bit_row(a, b)[1] if a and b else 0


def _bit_row(a: list, b: list) -> tuple[int, int]:
    """The row of bits after all of a against b (bit j is 0 where the length grows at b[j]), and the number of zeros."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row, len(b) - row.bit_count()


def _growth(a: list, b: list) -> np.ndarray:
    """Length of the common subsequence of a with the first 0, 1, ... of b."""
    if not b:
        return np.zeros(1, dtype=np.int64)
    row = _bit_row(a, b)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, rising."""
    first, out, work = 0, [], []
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    work.append((first, len(a) - last, first, len(b) - last))
    while work:
        i1, i2, j1, j2 = work.pop()
        if i1 >= i2 or j1 >= j2:
            continue
        left, right = a[i1:i2], b[j1:j2]
        places: dict = {}
        for j, y in enumerate(right):
            places.setdefault(y, []).append(j)
        pairs = sum(len(places.get(x, ())) for x in left)
        if pairs <= PAIRS * (len(left) + len(right)) or len(left) == 1:
            out += [(i + i1, j + j1) for i, j in _along_pairs(left, places)]
            continue
        # Halve the left side and part the right one where both halves together match most.
        half = len(left) // 2
        ahead = _growth(left[:half], right)
        behind = _growth(left[half:][::-1], right[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        work += [(i1, i1 + half, j1, j1 + cut), (i1 + half, i2, j1 + cut, j2)]
    out += [(i, i) for i in range(first)] + [(len(a) - k, len(b) - k) for k in range(1, last + 1)]
    return sorted(out)


def _along_pairs(left: list, places: dict) -> list[tuple[int, int]]:
    """The longest rising chain of pairs of equal lines: the least end of chains of each length, with links back."""
    ends: list[int] = []
    tails: list[tuple] = []
    for i, x in enumerate(left):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            node = (i, j, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(node)
            else:
                ends[k], tails[k] = j, node
    out, node = [], tails[-1] if tails else None
    while node is not None:
        out.append((node[0], node[1]))
        node = node[2]
    return out[::-1]


def steps_between(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """(tag, a_start, a_stop, b_start, b_stop) that lead from a to b."""
    out, i, j = [], 0, 0
    pairs = [*matched(a, b), (len(a), len(b))]
    at = 0
    while at < len(pairs):
        x, y = pairs[at]
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        run = at
        while run + 1 < len(pairs) and pairs[run + 1] == (pairs[run][0] + 1, pairs[run][1] + 1) and run + 1 < len(pairs) - 1:
            run += 1
        if at < len(pairs) - 1:
            out.append(("equal", x, pairs[run][0] + 1, y, pairs[run][1] + 1))
            i, j = pairs[run][0] + 1, pairs[run][1] + 1
        at = run + 1
    return out


@F.pandas_udf(STEPS)
def line_steps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Steps from the lines of a to those of b; a null text counts as empty. Lines end as str.splitlines() ends them."""
    names = ("tag", *PLACES)
    return pd.Series([[dict(zip(names, s, strict=True)) for s in steps_between((x or "").splitlines(), (y or "").splitlines())] for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("added", "deleted", "changed", "first_change")]))
def line_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """What diff_counts() says of line_steps(), without holding the steps of more than one pair of texts."""
    rows = []
    for x, y in zip(a, b, strict=True):
        steps = [s for s in steps_between((x or "").splitlines(), (y or "").splitlines()) if s[0] != "equal"]
        gone, add = sum(s[2] - s[1] for s in steps), sum(s[4] - s[3] for s in steps)
        rows.append((add, gone, add + gone, steps[0][1] if steps else None))
    found = pd.DataFrame(rows, columns=["added", "deleted", "changed", "first_change"])
    return found.astype({"first_change": "Int32"})


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence of the characters of two texts over their lengths together; 1 for two empty
    ones."""
    return pd.Series([2 * lcs_length(list(x or ""), list(y or "")) / (len(x or "") + len(y or "")) if x or y else 1.0 for x, y in zip(a, b, strict=True)])


def _changes(steps: Column) -> Column:
    return F.filter(steps, lambda s: s["tag"] != "equal")


def diff_counts(steps: Column) -> Column:
    """struct<added, deleted, changed, first_change>: lines of either side that steps touch, and the first of a's (from 0
    on) that changes, null for none."""
    add = F.aggregate(_changes(steps), F.lit(0), lambda n, s: n + s["b_stop"] - s["b_start"])
    gone = F.aggregate(_changes(steps), F.lit(0), lambda n, s: n + s["a_stop"] - s["a_start"])
    return F.struct(add.alias("added"), gone.alias("deleted"), (add + gone).alias("changed"), F.get(_changes(steps), F.lit(0))["a_start"].alias("first_change"))


def changed_places(steps: Column, side: str = "b") -> Column:
    """Numbers (from 1 on) of the lines of one side (a or b) that steps touch, rising."""
    spans = F.filter(_changes(steps), lambda s: s[f"{side}_stop"] > s[f"{side}_start"])
    return F.flatten(F.transform(spans, lambda s: F.sequence(s[f"{side}_start"] + 1, s[f"{side}_stop"])))


def changed_lines(a: Column | str, b: Column | str) -> Column:
    """Numbers (from 1 on) of the lines of b that differ from a's."""
    return changed_places(line_steps(a, b))


def hunk_text(a: Column, b: Column, steps: Column) -> Column:
    """What changes, line by line: "- " before lines of a, "+ " before those of b; "(none)" if nothing does. a and b are
    arrays of lines."""
    lines = F.transform(
        _changes(steps),
        lambda s: F.concat(
            F.transform(F.slice(a, s["a_start"] + 1, s["a_stop"] - s["a_start"]), lambda x: F.concat(F.lit("- "), x)),
            F.transform(F.slice(b, s["b_start"] + 1, s["b_stop"] - s["b_start"]), lambda x: F.concat(F.lit("+ "), x)),
        ),
    )
    return F.coalesce(F.nullif(F.array_join(F.flatten(lines), "\n"), F.lit("")), F.lit("(none)"))
