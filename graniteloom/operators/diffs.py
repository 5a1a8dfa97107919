"""Unified diffs and code lines: numbered lines, hunks, changed-line filters, windows and chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteloom.functions.tables import windows_of

#: Paths that hold no code of interest, and lines that say nothing.
EXCLUDED_PATHS = r"(^|/)(tests?|vendor|node_modules|dist|build)/|[.]lock$|[.]min[.]js$"
NOISE_LINES = r"^[ \t]*(//|#|[*]|import |from |[{}();]*[ \t]*$)"
FILES = r" a/(\S+) b/(\S+)$"
HUNK = r"^@@ -([0-9]+)(?:,[0-9]+)? [+]([0-9]+)(?:,[0-9]+)? @@"


def numbered(lines: DataFrame, key: list[str], pos: str, line: str) -> DataFrame:
    """The lines of hunks with hunk (1, 2, ...), side ("-", "+" or " "), body, old_no, new_no, file and post_path.

    Headers carry the first numbers of both sides forward; the counters start anew with every hunk. Lines before the
    first header are left out. old_no is null on the new side, new_no on the old side. A `diff --git` line ends a hunk and
    begins a file; lines of a file whose paths do not read are left out, and so are `---`, `+++` and `\\` lines. Diffs
    without such lines have null files.
    """
    text = F.col(line)
    opens, header = F.startswith(text, F.lit("diff --git")), text.rlike(HUNK)
    order = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # -1 stands for "no hunk yet" after a file's first line.
    first = [F.last(F.when(opens, F.lit(-1)).when(header, F.regexp_extract(line, HUNK, i).cast("int")), ignorenulls=True).over(order) for i in (1, 2)]
    paths = [F.last(F.when(opens, F.regexp_extract(line, FILES, i)), ignorenulls=True).over(order) for i in (1, 2)]
    laid = lines.select("*", F.sum(header.cast("int")).over(order).alias("hunk"), first[0].alias("_old"), first[1].alias("_new"), header.alias("_header"), paths[0].alias("file"), paths[1].alias("post_path"))
    side = F.when(F.left(text, F.lit(1)).isin("+", "-"), F.left(text, F.lit(1))).otherwise(" ")
    other = opens | text.rlike(r"^(---|[+][+][+]|\\)")
    inside = (F.col("hunk") > 0) & ~F.col("_header") & ~other & (F.col("_old") >= 0) & (F.coalesce("file", F.lit("-")) != "")
    body = laid.where(inside).withColumns({"side": side, "body": F.substring(line, 2, 1 << 30)})
    upto = Window.partitionBy(*key, "hunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = {s: F.sum((F.col("side") != o).cast("int")).over(upto) for s, o in (("old", "+"), ("new", "-"))}
    out = body.withColumns({"old_no": F.when(F.col("side") != "+", F.col("_old") + count["old"] - 1), "new_no": F.when(F.col("side") != "-", F.col("_new") + count["new"] - 1)})
    return out.drop("_old", "_new", "_header")


def telling(line: Column) -> Column:
    """Whether a line says something: it is no comment, import or bracket."""
    return ~line.rlike(NOISE_LINES)


def representative(changed: DataFrame, key: list[str]) -> DataFrame:
    """key, line and n_hunks: the smallest telling deleted line of the earliest hunk that has one, and how many have."""
    rows = changed.where((F.col("side") == "-") & telling(F.col("body")))
    found = rows.groupBy(*key).agg(F.min(F.struct("hunk", "old_no")).alias("_f"), F.count_distinct("hunk").alias("n_hunks"))
    return found.select(*key, F.col("_f.old_no").alias("line"), "n_hunks")


def commit_size(changed: DataFrame, key: list[str], most: int = 30) -> DataFrame:
    """key and n_deleted of the commits with at least one and at most `most` deleted lines."""
    counts = changed.groupBy(*key).agg(F.count_if(F.col("side") == "-").alias("n_deleted"))
    return counts.where(F.col("n_deleted").between(1, most))


def class_filter(rows: DataFrame, patterns: DataFrame, cls: str, text: str) -> DataFrame:
    """Rows whose text matches the pattern of their class (patterns: cls, pattern); a class without one passes."""
    known = patterns.select(F.col(cls).alias("_cls"), "pattern")
    return rows.join(known, F.col(cls) == F.col("_cls"), "left").where(F.col("pattern").isNull() | F.expr(f"{text} rlike pattern")).drop("_cls", "pattern")


def banned_outside(text: Column, fence: str, banned: str) -> Column:
    """Whether a banned pattern stands outside the stretches that `fence` matches."""
    return F.regexp_replace(text, f"(?s){fence}", " ").rlike(banned)


def rule_findings(changed: DataFrame, key: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """key, cls and lines: the added lines (ascending) that each rule (class, pattern) matches; comments are skipped."""
    added = changed.where((F.col("side") == "+") & telling(F.col("body")))
    hits = F.array_compact(F.array(*(F.when(F.col("body").rlike(p), F.lit(c)) for c, p in rules)))
    each = added.select(*key, "new_no", F.explode(hits).alias("cls")).distinct()
    return each.groupBy(*key, "cls").agg(F.array_sort(F.collect_list("new_no")).alias("lines"))


def keyword_lines(changed: DataFrame, key: list[str], words: dict[str, list[str]]) -> DataFrame:
    """key, cls, lines and fallback for each class: all added lines (rising) that hold one of its words in any case, else the
    first line of the first hunk alone. Diffs without a line on the new side are left out."""
    new = changed.where("new_no IS NOT NULL")
    body = F.lower("body")
    holds = {c: F.exists(F.array(*(F.lit(w.lower()) for w in list_)), lambda w: F.contains(body, w)) if list_ else F.lit(False) for c, list_ in words.items()}
    lines = [F.array_sort(F.collect_list(F.when((F.col("side") == "+") & h, F.col("new_no")))).alias(f"w{i}") for i, h in enumerate(holds.values())]
    found = new.groupBy(*key).agg(F.min(F.struct("hunk", "new_no"))["new_no"].alias("_start"), *lines)
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("cls"), F.when(F.size(f"w{i}") > 0, F.col(f"w{i}")).otherwise(F.array("_start")).alias("lines"), (F.size(f"w{i}") == 0).alias("fallback")) for i, c in enumerate(words))))
    return found.select(*key, each)


def around(lines: Column, at: Column, reach: int) -> Column:
    """The lines from `reach` before the line `at` (from 1 on) to `reach` after it, as an array."""
    first = F.greatest(F.lit(1), at - reach)
    return F.slice(lines, first, F.greatest(F.lit(0), F.least(F.size(lines), at + reach) - first + 1))


def evenly(path: Column, most: int = 10) -> Column:
    """A path's ends and evenly spaced steps between them, `most` in all, a place of a half going to the even one; a shorter
    path whole."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(path, F.bround(i * (F.size(path) - 1) / (most - 1), 0).cast("int")))
    return F.when(F.size(path) <= most, path).otherwise(picks)


def inserted(lines: Column, at: Column, mark: str) -> Column:
    """lines with a mark before the line `at` (from 1 on)."""
    return F.flatten(F.transform(lines, lambda x, i: F.when(i + 1 == at, F.array(F.lit(mark), x)).otherwise(F.array(x))))


def chunk_ends(text: str, most: int) -> list[int]:
    """Ends (exclusive) of the chunks of a text: as many whole lines as fit `most` characters; a longer line is a chunk of
    its own."""
    ends, begin, at = [], 0, 0
    for line in text.split("\n"):
        line_chars = min(len(line) + 1, len(text) - at)
        if at > begin and at + line_chars - begin > most:
            ends.append(at)
            begin = at
        at += line_chars
    return [*ends, at] if at > begin or not ends else ends


def cut_up(rows: DataFrame, id: str, text: str, most: int, windows: bool = False) -> DataFrame:
    """(id, part, start, stop): chunks of whole lines, or overlapping windows, of each text, in code points.

    Where a chunk ends depends on the one before it, so a text is cut in the task that reads it; null counts as empty. A
    batch of texts gives one batch of arrays, which Spark spreads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = [], []
            for t in batch.column(1).to_pylist():
                ends = chunk_ends(t, most)
                spans = windows_of(t, most) if windows else zip([0, *ends[:-1]], ends, strict=True)
                a, b = zip(*spans, strict=True) if t or not windows else ((), ())
                starts.append(a)
                stops.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, stops))], ["id", "starts", "stops"])

    kind = rows.schema[id].dataType.simpleString()
    body = rows.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    cut = body.mapInArrow(run, f"id {kind}, starts array<long>, stops array<long>")
    return cut.select(F.col("id").alias(id), F.posexplode(F.arrays_zip("starts", "stops")).alias("part", "s")).select(id, "part", F.col("s.starts").alias("start"), F.col("s.stops").alias("stop"))
