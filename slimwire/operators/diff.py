"""Line diff between the previous and the current version of a file.

Two forms:

* ``diff_counts`` — native Spark: common prefix and suffix lines of the two line
  arrays and the sizes of the changed middle. Exact for a single edited region,
  an upper bound for several separated edits.
* ``line_diff_udf`` — the unified-diff text (4 context lines, ``---``/``+++``
  header, ``@@ -a,b +c,d @@`` hunks) of the shortest edit script, computed per
  (previous, current) pair in an Arrow-batched pandas UDF. Spark has no line-diff
  expression; the pairs are produced by the ``lag`` window, so the UDF is a per-row
  helper only.

A line is what ends in a newline, so a file that gains or loses its final newline
has its last line changed.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONTEXT_LINES = 4
HUNK = re.compile(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@")
NO_NEWLINE = "\\ No newline at end of file"
GREEDY = 512           # changes up to which the furthest-reaching search holds its trail (1 MB)
OFTEN = 64             # places of a line from which its mask is kept
OPEN_LINE = "\u0000"   # ends a last line that has no newline, while lines are compared


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    return [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest edit script as (' ', i, j), ('-', i, j), ('+', i, j) steps, in memory linear in the lines.

    Few changes are found by the greedy furthest-reaching search, whose trail is as long as the square of the changes;
    more than GREEDY by halving the lines at the best place (both give a shortest script)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x_end, y_end = len(a) - lo - hi, len(b) - lo - hi
    names: dict[str, int] = {}
    old = [names.setdefault(x, len(names)) for x in a[lo:lo + x_end]]
    new = [names.setdefault(x, len(names)) for x in b[lo:lo + y_end]]
    steps = _furthest_reaching(old, new)
    if steps is None:
        steps = _steps_between(common_lines(old, new), x_end, y_end)
    return ([(" ", i, i) for i in range(lo)] + [(mark, lo + x, lo + y) for mark, x, y in steps]
            + [(" ", lo + x_end + i, lo + y_end + i) for i in range(hi)])


def _furthest_reaching(a: list[int], b: list[int]) -> list[tuple[str, int, int]] | None:
    """A shortest script of at most GREEDY changes; None if there is none."""
    shared = set(a) & set(b)
    if sum(x not in shared for x in a) + sum(x not in shared for x in b) > GREEDY:
        return None  # a line of one side alone is a change
    x_end, y_end = len(a), len(b)
    reach, trail, done = {1: 0}, [], False
    for d in range(min(x_end + y_end, GREEDY) + 1):
        trail.append(array("l", (reach.get(k, 0) for k in range(-d - 1, d + 2))))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < x_end and y < y_end and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= x_end and y >= y_end:
                done = True
                break
        if done:
            break
    if not done:
        return None
    steps, x, y = [], x_end, y_end
    for d in range(len(trail) - 1, -1, -1):
        before, k = trail[d], x - y
        at = k + d + 1  # place of diagonal k in the trail
        from_k = k + 1 if k == -d or (k != d and before[at - 1] < before[at + 1]) else k - 1
        px = before[from_k + d + 1] if d else 0
        py = px - from_k if d else 0
        while x > px and y > py:
            x, y = x - 1, y - 1
            steps.append((" ", x, y))
        if d:
            x, y = px, py
            steps.append(("+", x, y) if from_k == k + 1 else ("-", x, y))
    return steps[::-1]


def _lengths(a: list[int], places: dict[int, list[int]], n: int) -> np.ndarray:
    """For each j the longest common subsequence of ``a`` and the first j of ``n`` lines, whose ``places`` are given.

    A bit a line of the second side; an unset bit is where the length goes up."""
    whole = (1 << n) - 1
    rises, held = whole, {}
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        mask = held.get(x)
        if mask is None:
            mask = sum(1 << p for p in at)
            if len(at) > OFTEN:
                held[x] = mask
        up = rises & mask
        rises = ((rises + up) | (rises ^ up)) & whole
    bits = np.unpackbits(np.frombuffer(rises.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _places(lines: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for j, x in enumerate(lines):
        out.setdefault(x, []).append(j)
    return out


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence, by halving: one side is cut in the middle and the other where the common
    lines before and behind are most. Lines that only one side has are left out first; one row of lengths is held at a time."""
    shared = set(a) & set(b)
    rows, cols = [i for i, x in enumerate(a) if x in shared], [j for j, x in enumerate(b) if x in shared]
    a, b = [a[i] for i in rows], [b[j] for j in cols]
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 == 1:
            try:
                out.append((i0, b.index(a[i0], j0, j1)))
            except ValueError:
                pass
            continue
        mid, right = (i0 + i1) // 2, b[j0:j1]
        before = _lengths(a[i0:mid], _places(right), j1 - j0)
        behind = _lengths(a[mid:i1][::-1], _places(right[::-1]), j1 - j0)[::-1]
        cut = j0 + int(np.argmax(before + behind))
        todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
    return sorted((rows[i], cols[j]) for i, j in out)


def _steps_between(common: list[tuple[int, int]], x_end: int, y_end: int) -> list[tuple[str, int, int]]:
    """The script that keeps the common lines; between them removed lines come first."""
    steps: list[tuple[str, int, int]] = []
    x = y = 0
    for i, j in [*common, (x_end, y_end)]:
        steps += [("-", k, y) for k in range(x, i)] + [("+", i, k) for k in range(y, j)]
        if i < x_end and j < y_end:
            steps.append((" ", i, j))
        x, y = i + 1, j + 1
    return steps


def unified_diff(path: str, old: str, new: str, context: int = CONTEXT_LINES) -> str:
    """Unified diff of two texts without the Index/=== preamble, trailing space trimmed."""
    a, b = _lines(old), _lines(new)
    steps = edit_script(a, b)
    out = [f"--- {path}\tprevious", f"+++ {path}\tcurrent"]
    changed = [i for i, s in enumerate(steps) if s[0] != " "]
    at = 0
    while at < len(changed):
        end = at
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * context + 1:
            end += 1
        hunk = steps[max(0, changed[at] - context):changed[end] + context + 1]
        removed = sum(s[0] != "+" for s in hunk)
        added = sum(s[0] != "-" for s in hunk)
        _, i, j = hunk[0]
        out.append(f"@@ -{i + 1 if removed else i},{removed} +{j + 1 if added else j},{added} @@")
        # within a run of changes the removed lines come first
        run: list[str] = []
        for mark, i, j in [*hunk, (" ", -1, -1)]:
            if mark == "+":
                run += _shown("+", b[j])
                continue
            if mark == " ":
                out += run
                run = []
            if i >= 0:
                out += _shown(mark, a[i])
        at = end + 1
    return "\n".join(out).rstrip()


def _shown(mark: str, line: str) -> list[str]:
    return [mark + line[:-1]] if line.endswith("\n") else [mark + line, NO_NEWLINE]


def apply_diff(old: str, diff: str) -> str:
    """The text that ``diff`` (as ``unified_diff`` makes it) turns ``old`` into.

    Raises ValueError where a line to keep or to remove isn't the old one's. A diff has lost the blanks at its end: blank
    lines to keep are taken from the hunk's line counts, the blanks that end a last added line are gone."""
    a, out, at = _lines(old), [], 0
    lines = diff.split("\n")[2:]
    k = 0
    while k < len(lines):
        head = HUNK.fullmatch(lines[k])
        if not head:
            raise ValueError(f"not a hunk: {lines[k]!r}")
        start, removed, added = int(head[1]), int(head[2]), int(head[4])
        start -= removed > 0  # lines before the hunk
        out += a[at:start]
        at, k = start, k + 1
        while removed or added:
            line = lines[k] if k < len(lines) else (" " if removed and added else "-" if removed else "+")
            k += 1
            text = line[1:] + "\n"
            if k < len(lines) and lines[k] == NO_NEWLINE:
                text, k = line[1:], k + 1
            if line[:1] in ("-", " ", ""):
                if at >= len(a) or a[at].rstrip() != text.rstrip():
                    raise ValueError(f"line {at + 1} isn't {text!r}")
                out += [] if line[:1] == "-" else [a[at]]
                at, removed = at + 1, removed - 1
            if line[:1] != "-":
                out += [text] if line[:1] == "+" else []
                added -= 1
    return "".join(out + a[at:])


@F.pandas_udf(StringType())
def apply_diff_udf(old: pd.Series, diff: pd.Series) -> pd.Series:
    """:func:`apply_diff` of each row; null where either side is."""
    return pd.Series([apply_diff(o, d) if isinstance(o, str) and isinstance(d, str) else None for o, d in zip(old, diff, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def line_diff_udf(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    res = []
    for p, o, n in zip(path, old, new):
        if p is None or o is None or n is None or (isinstance(o, float)) or isinstance(n, float):
            res.append(None)
        else:
            res.append(unified_diff(p, o, n))
    return pd.Series(res, dtype=object)


def with_line_arrays(df: DataFrame, old: str, new: str) -> DataFrame:
    """Materialize the two line arrays once (and their sizes) before :func:`diff_counts`."""
    return (df.withColumn("_la", F.split(F.col(old), "\n", -1)).withColumn("_lb", F.split(F.col(new), "\n", -1))
              .withColumn("_na", F.size("_la")).withColumn("_nb", F.size("_lb"))
              .withColumn("_m", F.least("_na", "_nb")))


def diff_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds struct ``counts`` (prefix, suffix, removed, added) of line counts, native Spark only."""
    df = with_line_arrays(df, old, new)
    a, b = F.col("_la"), F.col("_lb")
    na, nb, m = F.col("_na"), F.col("_nb"), F.col("_m")
    # first index (1-based) where lines differ, else m+1
    pre = F.coalesce(F.array_position(
        F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
                    lambda i: F.when(i <= m, F.element_at(a, i.cast("int")) == F.element_at(b, i.cast("int"))).otherwise(F.lit(False))),
        F.lit(False)), F.lit(0)) - 1
    df = df.withColumn("_pre", F.when(pre < 0, m).otherwise(pre))
    prefix = F.col("_pre")
    df = df.withColumn("_rest", m - prefix)
    rest = F.col("_rest")
    suf = F.array_position(
        F.transform(F.sequence(F.lit(1), F.greatest(rest, F.lit(1))),
                    lambda i: F.when(i <= rest, F.element_at(a, (na - i + 1).cast("int")) == F.element_at(b, (nb - i + 1).cast("int")))
                               .otherwise(F.lit(False))),
        F.lit(False)) - 1
    suffix = F.when(rest == 0, F.lit(0)).when(suf < 0, rest).otherwise(suf)
    df = df.withColumn("_suf", suffix)
    suffix = F.col("_suf")
    return df.withColumn("counts", F.struct(
        prefix.cast("bigint").alias("prefix"), suffix.cast("bigint").alias("suffix"),
        (na - prefix - suffix).cast("bigint").alias("removed"),
        (nb - prefix - suffix).cast("bigint").alias("added"))).drop(
        "_la", "_lb", "_na", "_nb", "_m", "_pre", "_rest", "_suf")


def with_unified_diff(df: DataFrame, path: str, old: str, new: str, out: str,
                      context: int = CONTEXT_LINES) -> DataFrame:
    """Native unified diff: one hunk around the changed middle (common prefix and
    suffix removed), ``context`` lines on each side, ``---``/``+++`` header.

    Stays in the JVM and keeps the child's partitioning (a Python UDF would hide
    it and cost an extra exchange inside the pipeline). Exact for one edited
    region; for several separated edits the single hunk is valid but not minimal.
    Rows where ``old`` or ``new`` is NULL get NULL.
    """
    # a final newline ends the last line rather than starting an empty one; a last line without one is another line
    def ended(c: str) -> Column:
        return F.when(F.col(c).endswith("\n"), F.regexp_replace(F.col(c), r"\n\z", "")).otherwise(F.concat(F.col(c), F.lit(OPEN_LINE)))
    df = df.withColumn("_uo", ended(old)).withColumn("_un", ended(new))
    df = diff_counts(df, "_uo", "_un")
    df = df.withColumn("_ua", F.split(F.col("_uo"), "\n", -1)).withColumn("_ub", F.split(F.col("_un"), "\n", -1))
    na, nb = F.size("_ua"), F.size("_ub")
    p, q = F.col("counts.prefix"), F.col("counts.suffix")
    start = F.greatest(p - context, F.lit(0))                       # 0-based first hunk line
    a_end, b_end = na - q, nb - q                                    # exclusive end of the change
    a_stop = F.least(a_end + context, na)
    b_stop = F.least(b_end + context, nb)

    def lines(arr: Column, lo: Column, hi: Column, mark: str) -> Column:
        piece = F.slice(arr, lo + 1, F.greatest(hi - lo, F.lit(0)))
        return F.transform(piece, lambda x: F.concat(F.lit(mark), F.replace(x, F.lit(OPEN_LINE), F.lit("\n" + NO_NEWLINE))))

    def rng(s: Column, n: Column) -> Column:
        return F.concat(F.when(n > 0, s + 1).otherwise(s).cast("string"), F.lit(","), n.cast("string"))

    header = F.array(F.concat(F.lit("--- "), F.col(path), F.lit("\tprevious")),
                     F.concat(F.lit("+++ "), F.col(path), F.lit("\tcurrent")),
                     F.concat(F.lit("@@ -"), rng(start, a_stop - start), F.lit(" +"),
                              rng(start, b_stop - start), F.lit(" @@")))
    body = F.concat(header, lines(F.col("_ua"), start, p, " "), lines(F.col("_ua"), p, a_end, "-"),
                    lines(F.col("_ub"), p, b_end, "+"), lines(F.col("_ua"), a_end, a_stop, " "))
    text = F.regexp_replace(F.array_join(body, "\n"), r"\s+\z", "")     # trimEnd
    return (df.withColumn(out, F.when(F.col(old).isNotNull() & F.col(new).isNotNull(), text))
              .drop("_ua", "_ub", "_uo", "_un", "counts"))
