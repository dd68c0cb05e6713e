"""Line dedup by pairwise alignment: shared rare lines find overlapping documents, patience diff aligns them.

A line is looked up by hash as the shortest run of ``min_chars`` from it on, and up to it: most lines are such a run by
themselves, short ones take their neighbours, so what is looked up is rare by itself.  A document shorter than that is
looked up whole.  Whatever occurs in more than one document links each later document to the first that has it ("later"
by id, null first, then row key), so n copies make n - 1 pairs at any n, and no list is capped.

Each pair is aligned by patience diff on all lines that the two share, common ones included: lines that occur once in
both anchor a longest increasing run, gaps between anchors are aligned likewise, and what touches an anchor extends it.
Only aligned blocks go, from the later document: those that hold a line that made the pair, and shorter ones at most
``gap`` lines from such a block in both documents, as between the changes of an edited copy.  A line that made the pair
but stands in another order is an anchor by itself, and its block what extends it.

Everything goes at any number of copies by default.  With ``rare``, a block goes only if it holds a line, or two adjacent
ones, that at most ``rare`` documents have (or ``rare_share`` of all, where that is more), is long (``long_chars`` characters, or more than
a sixth as many words), or is all of its document; other frequent lines, as license notes, then stay everywhere.

Lines are compared as they are.  Blank lines link nothing, end no block and stay.  Null text has no lines and stays
null.  Rows alike in id and text are one document here, and change alike.  Lines and runs are hashed to 128 bits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import RESERVED, ROW, emit_rows, quoted, row_key, stored
from tarmac.llm.words import FIRST, SECOND, Words, slices

#: Letters a word, where a length in characters stands for one in words.
LETTERS = 6


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops, ends, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        ends[pile : pile + 1] = [i]
    at, out = ends[-1] if ends else -1, []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of equal items that patience diff aligns, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        where, twice = {}, set()
        for i in range(a0, a1):
            (twice.add if a[i] in where else lambda _: None)(a[i])
            where[a[i]] = i
        here, again = {}, set()
        for j in range(b0, b1):
            (again.add if b[j] in here else lambda _: None)(b[j])
            here[b[j]] = j
        both = sorted((where[x], j) for x, j in here.items() if x in where and x not in twice and x not in again)
        anchors = [both[i] for i in _increasing([j for _, j in both])]
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            todo += [(x + 1, y, v + 1, w) for (x, v), (y, w) in zip(edges, edges[1:], strict=False) if x + 1 < y and v + 1 < w]
    return sorted(out)


def blocks(later: dict[int, object], earlier: dict[int, object]) -> list[tuple[int, int, int]]:
    """Aligned blocks ``(first line of the later document, of the earlier one, lines)``; both map line numbers to shared lines."""
    mine, theirs = sorted(later), sorted(earlier)
    out: list[tuple[int, int, int]] = []
    for x, y in patience([later[i] for i in mine], [earlier[j] for j in theirs]):
        i, j = mine[x], theirs[y]
        if out and (i, j) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def _line_lists(docs: DataFrame) -> DataFrame:
    """``(_id, _row, h1, h2, number, chars, words)``: for each document lists over its lines that are not blank."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                ends = np.flatnonzero(words.data == 10)
                starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
                row = np.searchsorted(words.rows, starts, "right") - 1
                number = np.arange(len(starts)) - np.searchsorted(starts, words.rows[:-1])[row] if len(starts) else starts
                n_words = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
                full = n_words > 0
                starts, ends, row, number, n_words = starts[full], ends[full], row[full], number[full], n_words[full]
                letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                bounds = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                listed = lambda x, t: pa.ListArray.from_arrays(bounds, pa.array(x.astype(t)))  # noqa: E731, B023
                yield {
                    "_id": part.column("_id"), "_row": part.column("_row"), "h1": listed(FIRST.words(words.data, starts, ends).view(np.int64), np.int64), "h2": listed(SECOND.words(words.data, starts, ends).view(np.int64), np.int64),
                    "number": listed(number, np.int32), "chars": listed(letters[ends] - letters[starts], np.int32), "words": listed(n_words, np.int32),
                }

    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    fields = {"_id": docs.schema["_id"].dataType, "_row": T.BinaryType(), "h1": longs, "h2": longs, "number": ints, "chars": ints, "words": ints}
    return emit_rows(docs.dropDuplicates(["_row"]), run, fields)


def spans(rows: np.ndarray, chars: np.ndarray, min_chars: int, twos: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(start, end)`` of the runs that are looked up, where ``rows[i]:rows[i + 1]`` are the lines of document ``i``.

    The shortest run of at least ``min_chars`` from each line on and up to each line, and all lines of a document that has
    none.  Every line of a block of that size lies in such a run inside the block.  With ``twos`` also two adjacent lines,
    which may be rare where neither is.
    """
    size = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    line, least = np.arange(len(chars)), max(min_chars, 1)
    doc = np.searchsorted(rows, line, "right") - 1
    ends, starts = np.searchsorted(size, size[:-1] + least), np.searchsorted(size, size[1:] - least, "right") - 1
    ahead, behind = ends <= rows[doc + 1], starts >= rows[doc]
    short = np.flatnonzero((np.diff(rows) > 0) & (size[rows[1:]] - size[rows[:-1]] < least))
    two = np.flatnonzero((line + 2 <= rows[doc + 1]) & (size[np.minimum(line + 2, len(chars))] - size[:-1] >= least)) if twos else line[:0]
    start = np.concatenate([line[ahead], starts[behind], rows[short], two])
    end = np.concatenate([ends[ahead], line[behind] + 1, rows[short + 1], two + 2])
    _, once = np.unique(start * (len(chars) + 1) + end, return_index=True)
    return start[once], end[once]


def _runs(lists: DataFrame, min_chars: int, twos: bool) -> DataFrame:
    """``(_id, _row, h1, h2, at, n)`` for each document and different run of lines: where it starts, and its lines."""

    def run(batches):
        for batch in batches:
            flat = lambda c: batch.column(c).flatten().to_numpy()  # noqa: E731, B023
            rows = np.concatenate([[0], np.cumsum(batch.column("chars").value_lengths().to_numpy())]).astype(np.int64)
            start, end = spans(rows, flat("chars"), min_chars, twos)
            h1, h2 = FIRST.spans(flat("h1").view(np.uint64), start, end), SECOND.spans(flat("h2").view(np.uint64), start, end)
            doc = np.searchsorted(rows, start, "right") - 1
            order = np.lexsort((start, h2, h1, doc))
            start, end, h1, h2, doc = (x[order] for x in (start, end, h1, h2, doc))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(new)
            own = batch.select(["_id", "_row"]).take(pa.array(doc[first]))
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array((start - rows[doc]).astype(np.int32)))
            yield {
                "_id": own.column("_id"), "_row": own.column("_row"), "h1": pa.array(h1[first].view(np.int64)), "h2": pa.array(h2[first].view(np.int64)),
                "at": at, "n": pa.array((end - start)[first].astype(np.int32)),
            }

    fields = {"_id": lists.schema["_id"].dataType, "_row": T.BinaryType(), "h1": T.LongType(), "h2": T.LongType(), "at": T.ArrayType(T.IntegerType()), "n": T.IntegerType()}
    return emit_rows(lists, run, fields)


def cut(later: list, earlier: list, linked: dict[tuple[int, int], bool], large: Callable[[int, int], bool], gap: int) -> set[int]:
    """Lines of the later document in aligned blocks that go.

    ``linked`` are the runs ``(first line, lines)`` that made the pair, each in both documents, and whether one is rare.
    ``large(first, end)`` tells of a block whether it goes without a rare run.
    """
    ends: dict[int, int] = {}
    for (s, n), rare in linked.items():
        if rare:
            ends[s] = min(s + n, ends.get(s, s + n))
    goes = lambda i, n: large(i, i + n) or any(ends.get(x, i + n + 1) <= i + n for x in range(i, i + n))
    both = set(later) & set(earlier)
    found = blocks({i: x for i, x in enumerate(later) if x in both}, {j: x for j, x in enumerate(earlier) if x in both})
    taken = [goes(i, n) for i, _, n in found]
    near = [i1 - i0 - n <= gap and j1 - j0 - n <= gap for (i0, j0, n), (i1, j1, _) in zip(found, found[1:], strict=False)]
    for k in range(1, len(found)):
        taken[k] = taken[k] or (taken[k - 1] and near[k - 1])
    for k in range(len(found) - 2, -1, -1):
        taken[k] = taken[k] or (taken[k + 1] and near[k])
    gone = {x for (i, _, n), t in zip(found, taken, strict=True) if t for x in range(i, i + n)}
    moved = [(s, n) for s, n in linked if not gone.issuperset(range(s, s + n))]
    first: dict[tuple, int] = {}
    for n in {n for _, n in moved}:
        for j in range(len(earlier) - n + 1):
            first.setdefault(tuple(earlier[j : j + n]), j)
    for s, n in sorted(moved):
        if gone.issuperset(range(s, s + n)):
            continue
        j = first[tuple(later[s : s + n])]
        i, end, last = s, s + n, j + n
        while i and j and later[i - 1] == earlier[j - 1]:
            i, j = i - 1, j - 1
        while end < len(later) and last < len(earlier) and later[end] == earlier[last]:
            end, last = end + 1, last + 1
        if goes(i, end - i):
            gone.update(range(i, end))
    return gone


def removals(
    docs: DataFrame, rare: int | None = None, min_chars: int = 40, long_chars: int = 300, doc_id: str = "doc_id", text: str = "text", rare_share: float = 0.01, gap: int = 2
) -> DataFrame:
    """``(_row, gone)``: for each row key with removed lines, a mask by line number."""
    # rows alike in id and text are one document
    lists = stored(_line_lists(docs.select(quoted(doc_id).alias("_id"), row_key(doc_id, text).alias("_row"), quoted(text).alias("_text"))))
    few = F.lit(True) if rare is None else F.col("docs") <= max(rare, int(rare_share * lists.count()))
    rows = _runs(lists, min_chars, rare is not None)
    shared = rows.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min(F.struct("_id", "_row")).alias("first"))
    shared = shared.where("docs > 1").select("h1", "h2", few.alias("rare"), F.col("first._row").alias("owner"))
    links = rows.select("_row", "h1", "h2", "at", "n").join(shared, ["h1", "h2"]).where("_row <> owner").select("_row", "owner", F.explode("at").alias("at"), "n", "rare")
    # a pair's runs are lines of one document, and so a bounded list
    pairs = stored(links.groupBy("_row", "owner").agg(F.collect_list(F.struct("at", "n", "rare")).alias("runs")))
    # each document's own lines come first, then its partners one a row, so they pass through a task without being gathered
    own = lists.join(pairs.select("_row").distinct(), "_row", "left_semi").select("_row", F.lit(None).cast("binary").alias("owner"), "h1", "number", "chars", "words", F.lit(None).cast(pairs.schema["runs"].dataType).alias("runs"))
    theirs = pairs.join(lists.select(F.col("_row").alias("owner"), "h1"), "owner")
    theirs = theirs.select("_row", "owner", "h1", *[F.lit(None).cast("array<int>").alias(c) for c in ("number", "chars", "words")], "runs")
    found = own.unionByName(theirs).repartition("_row").sortWithinPartitions("_row", "owner")

    def fold(batches):
        key, gone = None, set()

        def mask():
            lines_gone = {number[x] for x in gone}
            return {"_row": pa.array([key], pa.binary()), "gone": pa.array([[x in lines_gone for x in range(max(lines_gone) + 1)]], pa.list_(pa.bool_()))}

        for batch in batches:
            column = {c: batch.column(c) for c in ("_row", "owner", "h1", "number", "chars", "words", "runs")}
            for i in range(batch.num_rows):
                listed = column["h1"][i].values.to_numpy(zero_copy_only=False).tolist()
                if not column["owner"][i].is_valid:
                    if gone:
                        yield mask()
                    key, gone, mine = column["_row"][i].as_py(), set(), listed
                    number = column["number"][i].as_py()
                    size, count = (np.concatenate([[0], np.cumsum(column[c][i].as_py(), dtype=np.int64)]).tolist() for c in ("chars", "words"))
                elif len(gone) < len(mine):
                    linked = {(x["at"], x["n"]): x["rare"] for x in column["runs"][i].as_py()}
                    large = lambda a, b: (b - a == len(mine) or size[b] - size[a] >= long_chars or (count[b] - count[a]) * LETTERS > long_chars)  # noqa: E731, B023
                    gone |= cut(mine, listed, linked, large, gap)
        if gone:
            yield mask()

    return emit_rows(found, fold, {"_row": T.BinaryType(), "gone": T.ArrayType(T.BooleanType())})


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with aligned blocks cut from ``text`` of later documents, and ``n_lines`` and ``n_lines_removed``."""
    # masks grow with the input: texts and masks are dealt by key at every size
    gone, parts = RESERVED + "gone", RESERVED + "lines"
    found = stored(removals(docs, doc_id=doc_id, text=text, **options)).select(F.col("_row").alias(ROW), F.col("gone").alias(gone))
    lines = F.split(quoted(text), "\n", -1)
    left = F.filter(parts, lambda _, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    kept = docs.drop(gone).withColumn(ROW, row_key(doc_id, text)).join(found.hint("merge"), ROW, "left").withColumn(parts, lines)
    cut = F.when(F.col(gone).isNull(), quoted(text)).otherwise(F.array_join(left, "\n"))
    removed = F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).cast("long")
    names = [c for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_lines_removed")]
    return kept.select(*map(quoted, names), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_lines_removed"), cut.alias(text))
