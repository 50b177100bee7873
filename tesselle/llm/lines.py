"""Line deduplication by a segment-partition edit join.

Equal lines are found by digest (128 bits of BLAKE2).  For lines that differ in at most ``edits`` characters: a line of
length l is cut into edits + 1 segments, and any line within that many edits of it holds one
of them whole, near its place.  Segments are index keys; a line probes, for its own and each
slightly smaller length, only those substrings whose shift a match could have (both from the
left and from the right end).  Keys that two different lines share make cells, whose lines
are compared by a bit-parallel edit distance over a band of 2 * edits + 1 diagonals, many
pairs at a time.  Linked lines are one class, and of a class the first line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.llm.cells import component_roots, large_cells, pairs_within, split, whole_cells
from tesselle.operators.components import connected_components
from tesselle.scratch import settled, stash

EDITS = 2
#: Equal lines are found from this length on (without outer blanks): all that aren't blank.  Lines of
#: NEAR_BYTES characters are joined by edits too: in shorter ones EDITS edits are over a sixth of the line.
LEAST_BYTES, NEAR_BYTES = 1, 12
#: A task remembers this many lines it has made keys for, so that a common line makes them rarely.
REMEMBERED = 500_000
CELL_ROWS = 4096
_LAST = (1 << 63) - 1
_NEWLINE = tk.lut(b"\n")


# ---------------------------------------------------------------- keys


def segments(length: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the edits + 1 segments of lines of these lengths."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    for i in range(parts):  # the last ones are one longer
        extra = np.maximum(0, i - (parts - longer))
        yield i * short + extra, short + (i >= parts - longer)


def line_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, valid)``, lines by columns; the first edits + 1 columns are a line's own segments.

    The rest are the substrings to look up.  A probe at a segment's own place and length has
    the same key as the index entry and isn't repeated.
    """
    columns, valid = [], []
    sums, scale = tk.rolling(data)

    def key(at: np.ndarray, size: np.ndarray, indexed: np.ndarray, part: int) -> np.ndarray:
        raw = (sums[at + size] - sums[at]) * scale[at]
        return tk.mixed(raw ^ tk.mixed(indexed.astype(np.uint64) * np.uint64(8) + np.uint64(part)))

    parts = list(segments(length, edits))
    for i, (p, size) in enumerate(parts):
        columns.append(key(start + p, size, length, i))
        valid.append(np.ones(len(start), bool))
    for less in range(edits + 1):
        for i, (p, size) in enumerate(segments(length - less, edits)):
            # What comes before the segment has at most i edits, what comes after at most the others.
            lo = np.maximum(np.maximum(0, p - i), p + less - (edits - i))
            hi = np.minimum(np.minimum(length - size, p + i), p + less + (edits - i))
            for shift in range(-edits, 2 * edits + 1):
                at = p + shift
                ok = (at >= lo) & (at <= hi)
                if (less == 0 and shift == 0) or not ok.any():
                    continue
                columns.append(key(start + np.where(ok, at, 0), np.where(ok, size, 0), length - less, i))
                valid.append(ok)
    return np.stack(columns, axis=1), np.stack(valid, axis=1)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row, number)`` of all non-blank lines without outer blanks; ``number``
    counts a text's line breaks before the line, from 0."""
    begin, stop, first = tk.spans(data, offsets, _NEWLINE)
    row = tk.row_of(first)
    if not len(begin):
        return begin, stop, row, begin
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    solid = np.append(np.flatnonzero(~tk.SPACES[data]), len(data))
    start = solid[np.searchsorted(solid, begin)]
    last = solid[np.maximum(np.searchsorted(solid, stop) - 1, 0)] + 1
    keep = start < stop
    return start[keep], last[keep], row[keep], (breaks[begin] - breaks[offsets[row]])[keep]


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where in them the spans start and end."""
    if not len(data) or data.max() < 128:
        return data, start, end
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), begins[start], begins[end]


def _keyed_lines(keyed: DataFrame, edits: int) -> DataFrame:
    """``(h1, h2, doc, rid, line, keys array<bigint>)`` of all lines that aren't blank; keys are null for lines that aren't joined by edits or whose keys the task has made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            doc, rid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, _, data, offsets in tk.chunks(batch.column(2)):
                start, end, row, line = line_spans(data, offsets)
                long = end - start >= LEAST_BYTES
                start, end, row, line = start[long], end[long], row[long], line[long]
                h1, h2 = tk.digests(data.tobytes(), start, end)
                points, begin, stop = characters(data, start, end)
                near = np.flatnonzero(stop - begin >= NEAR_BYTES)
                fresh = []
                for i, h in zip(near.tolist(), h1[near].tolist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        fresh.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                fresh = np.array(fresh, np.int64)
                count = np.zeros(len(start), np.int64)
                flat = np.zeros(0, np.int64)
                if len(fresh):
                    keys, valid = line_keys(points, begin[fresh], (stop - begin)[fresh], edits)
                    # Own segments first: their number is the same for all lines.
                    flat, count[fresh] = keys[valid].view(np.int64), valid.sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc[a + row]), pa.array(rid[a + row]), pa.array(line.astype(np.int32)), lists], names=["h1", "h2", "doc", "rid", "line", "keys"]
                )

    return keyed.select("doc", "rid", "text").mapInArrow(run, "h1 bigint, h2 bigint, doc bigint, rid bigint, line int, keys array<bigint>")


def shared_rows(key: np.ndarray, ident: np.ndarray, own: np.ndarray, held: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """The rows of one step of ``_shared_keys`` that go on, and what the next step needs of the last key.

    Rows are sorted by key, a line's own segments first; ``held`` is ``(key, id, settled)``: the
    first line of the key that the step before ended in, and whether a second one was there.
    A key whose first row isn't an own segment has none and needs no memory either.
    """
    edge = np.flatnonzero(np.diff(key)) + 1
    first = np.concatenate([[0], edge])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    leader, has_own = ident[first].copy(), own[first].copy()
    goes_on = held is not None and held[0] == key[0]
    if goes_on:
        leader[0], has_own[0] = held[1] if held[1] is not None else ident[0], held[1] is not None
    several = np.logical_or.reduceat(ident != leader[group], first)
    if goes_on and held[2]:
        several[0] = True
    keep = (several & has_own)[group]
    out_key, out_id = key[keep], ident[keep]
    if goes_on and not held[2] and has_own[0] and several[0]:
        out_key, out_id = np.append(out_key, key[0]), np.append(out_id, leader[0])
    last = (int(key[-1]), int(leader[-1]) if has_own[-1] else None, bool(several[-1]))
    return out_key, out_id, last


def _shared_keys(tokens: DataFrame) -> DataFrame:
    """``(key, id)`` of the keys that two different lines have, one of them as its own segment.

    A key's rows are passed on as they come: a task remembers one line of its last key,
    however many lines have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                key, ident, held = shared_rows(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)), held)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ident)], names=["key", "id"])

    rows = tokens.select("key", "id", "own").repartition("key").sortWithinPartitions("key", F.desc("own"))
    return rows.mapInArrow(run, "key bigint, id bigint")


# ---------------------------------------------------------------- verification


def points_of(line: bytes | str) -> np.ndarray:
    """The code points of a line; bytes are ASCII or any other single-byte symbols."""
    return np.frombuffer(line, np.uint8) if isinstance(line, bytes) else np.frombuffer(line.encode("utf-32-le"), "<u4")


def within_edits(a: list[bytes | str], b: list[bytes | str], edits: int) -> np.ndarray:
    """Whether each pair is at most ``edits`` insertions, deletions and replacements apart.

    Myers' bit-parallel column step in Hyyro's banded form: the band's vertical differences
    of one pair are the bits of a word, and the words of all pairs step together, column by
    column.  The band moves down one row a column, so its words move one bit.  Pairs whose
    distance exceeds the limit are dropped as they show.
    """
    out = np.zeros(len(a), bool)
    swap = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    m, n = np.array([len(x) for x, _ in swap], np.int64), np.array([len(y) for _, y in swap], np.int64)
    width = 2 * edits + 1
    kind = np.uint16 if width < 14 else np.uint64
    ones = kind((1 << width) - 1)
    live = np.flatnonzero(m - n <= edits)
    for at in range(0, len(live), 4096):
        rows = live[np.argsort(n[live], kind="stable")][at : at + 4096]
        tall, short = int(m[rows].max()), int(n[rows].max())
        wide = any(isinstance(s, str) for r in rows.tolist() for s in swap[r])
        symbol, none = (np.uint32, 1 << 31) if wide else (np.uint8, 254)  # these two symbols are in no text
        x = np.full((tall + 3 * edits + 2, len(rows)), none + 1, symbol)
        y = np.full((short, len(rows)), none, symbol)
        for c, r in enumerate(rows.tolist()):
            x[edits : edits + m[r], c] = points_of(swap[r][0])
            y[: n[r], c] = points_of(swap[r][1])
        # Rows from 1 on differ by +1 from the one above before the first column, others don't.
        up = np.full(len(rows), ones & ~kind((1 << edits) - 1), kind)
        down = np.zeros(len(rows), kind)
        score, size, final = m[rows] - n[rows], n[rows], (edits + m[rows] - n[rows]).astype(kind)
        names = rows
        for j in range(short):
            same = np.zeros(len(names), kind)
            for bit in range(width):
                same |= (x[j + bit] == y[j]).astype(kind) << kind(bit)
            diagonal = ((((same & up) + up) ^ up) | same | down) & ones  # equal to the value up-left
            right = down | (~(diagonal | up) & ones)
            left = diagonal & up
            shifted = diagonal >> kind(1)
            up, down = left | (~(shifted | right) & ones), shifted & right
            score = score + ((j < size) & ((diagonal >> final) & kind(1) == 0))
            if j % 16 == 15:
                keep = score <= edits
                if keep.mean() < 0.75:
                    names, score, size, final, up, down = names[keep], score[keep], size[keep], final[keep], up[keep], down[keep]
                    x, y = np.ascontiguousarray(x[:, keep]), np.ascontiguousarray(y[:, keep])
                    if not len(names):
                        break
        out[names] = score <= edits
    return out


def profiles(lines: list[bytes | str]) -> np.ndarray:
    """How often the characters of each of 32 kinds occur; an edit changes two counts by one at most."""
    size = np.array([len(x) for x in lines], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint8), *map(points_of, lines)])
    kind = np.repeat(np.arange(len(lines)) * 32, size) + (flat & 31)
    return np.bincount(kind, minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)


def near_pairs(lines: list[bytes | str], counts: np.ndarray, a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Which pairs of lines are within ``edits``: by profile first, then by edit distance."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 100_000):
        i, j = a[at : at + 100_000], b[at : at + 100_000]
        may = at + np.flatnonzero(np.abs(counts[i] - counts[j]).sum(1) <= 2 * edits)
        out[may] = within_edits([lines[k] for k in a[may].tolist()], [lines[k] for k in b[may].tolist()], edits)
    return out


def _near_lines(cells: DataFrame, edits: int) -> DataFrame:
    """``(src, dst)`` links between the lines of each cell ``(key, lo, hi, id, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in whole_cells(batches, 3):
            ident, lines = rows.column("id").to_numpy(), [x if x.isascii() else x.decode() for x in rows.column("content").to_pylist()]
            # A line may have a cell's key more than once.
            order = np.lexsort((ident, cell))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (ident[order[1:]] != ident[order[:-1]]) | (cell[order[1:]] != cell[order[:-1]])
            order = order[fresh]
            cell, ident, lines = cell[order], ident[order], [lines[i] for i in order.tolist()]
            sets = [p for p in pairs_within(cell, 32) if len(p[0])]
            a, b = (np.concatenate(x) for x in zip(*sets, strict=True)) if sets else (np.zeros(0, np.int64),) * 2
            # The same two lines may meet in several cells of this step.
            pair = np.unique(np.stack([np.minimum(ident[a], ident[b]), np.maximum(ident[a], ident[b])], 1), axis=0, return_index=True)[1] if len(a) else a
            a, b = a[pair], b[pair]
            counts = profiles(lines)
            ok = near_pairs(lines, counts, a, b, edits)
            src, dst = [ident[a[ok]]], [ident[b[ok]]]
            for i, e in large_cells(cell, 32):

                def near(asked: np.ndarray, others: np.ndarray, i: int = i, lines: list = lines, counts: np.ndarray = counts) -> tuple[np.ndarray, np.ndarray]:
                    q, v = np.repeat(np.arange(len(asked)), len(others)), np.tile(np.arange(len(others)), len(asked))
                    hit = near_pairs(lines, counts, i + asked[q], i + others[v], edits)
                    return q[hit], v[hit]

                root = component_roots(e - i, near, 16)
                linked = np.flatnonzero(root != np.arange(e - i))
                src.append(ident[i:e][linked])
                dst.append(ident[i:e][root[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    rows = cells.select("key", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "id", "content")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "src bigint, dst bigint")


def _contents(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, content binary)`` of the wanted lines ``(id, doc, rid, line)``."""
    lists = wanted.groupBy("doc", "rid").agg(F.collect_list(F.struct("id", "line")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, content = [], []
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                for w in want:
                    ids.append(w["id"])
                    content.append(lines[w["line"]].strip(b" \t\n\x0b\x0c\r"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.binary())], names=["id", "content"])

    texts = keyed.join(lists, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).select("text", "want")
    return texts.mapInArrow(run, "id bigint, content binary")


def line_links(keyed: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """``(src, dst)``: links between the ids (first hashes) of different lines within ``edits``."""
    own = F.col("place") <= edits
    tokens = lines.filter(F.size("keys") > 0).select(F.col("h1").alias("id"), F.posexplode("keys").alias("place", "key")).select("key", "id", own.alias("own"))
    shared = stash(_shared_keys(tokens))
    ids = shared.select("id").distinct()
    # Grouped before the join, so that a common line is one row for each task.
    first = lines.groupBy(F.col("h1").alias("id")).agg(F.min(F.struct("doc", "rid", "line")).alias("f")).join(ids, "id", "left_semi").select("id", "f.*")
    contents = stash(_contents(keyed, first))
    return _near_lines(split(shared, ["key"], "id", CELL_ROWS).join(contents, "id"), edits)


def _cuts(docs: DataFrame, edits: int) -> DataFrame:
    """``(doc, rid, cut array<int>, n_near, n_links)`` of the documents with a line that others are linked to."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), tk.row_key("doc_id", "text").alias("rid"), "text")
    lines = stash(_keyed_lines(keyed, edits))
    links = stash(line_links(keyed, lines, edits))
    classes = stash(connected_components(links).select(F.col("node").alias("h1"), F.col("component").alias("c")))
    # A class is its least line's hash; a line without near ones is a class by both its hashes.
    placed = lines.select("h1", "h2", "doc", "rid", "line").join(classes, "h1", "left")
    placed = stash(placed.select("h1", "doc", "rid", "line", F.coalesce("c", "h1").alias("c1"), F.when(F.col("c").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2")).distinct())
    first = placed.groupBy("c1", "c2").agg(F.min(F.struct("doc", "rid", "line", "h1")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    first = stash(first)  # a common line's class can then be split in the join
    met = placed.join(first, ["c1", "c2"])
    gone = ~((F.col("doc") == F.col("f.doc")) & (F.col("rid") == F.col("f.rid")) & (F.col("line") == F.col("f.line")))
    marks = met.select("doc", "rid", "line", gone.alias("gone"), (F.col("h1") != F.col("f.h1")).alias("near"), (F.col("n") - 1).alias("n"))
    return marks.groupBy("doc", "rid").agg(F.collect_list(F.when(F.col("gone"), F.col("line"))).alias("cut"), F.sum((F.col("gone") & F.col("near")).cast("int")).alias("n_near"), F.sum("n").alias("n_links"))


def deduplicate(docs: DataFrame, edits: int = EDITS, carry: bool = False) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_near, n_links, kept string)`` for every row of ``docs``;
    with ``carry`` also ``row``, the input row as a struct.

    Lines are what ``\\n`` separates, compared without outer blanks.  Equal lines of any
    length, and lines of at least NEAR_BYTES characters that differ in at most ``edits``
    characters, are linked; linked lines are a class, of which the first (by doc_id, then place)
    stays and the others go.  ``n_near`` counts removed lines that differ from their class's
    first, ``n_links`` the other lines of all classes that a document's lines are in.  Kept
    lines are unchanged.

    Null and empty texts have no lines; blank lines stay; a null doc_id counts as
    larger than any other; rows that repeat an id and its text are one document and each get
    a row; other columns are ignored; an empty table gives no rows.
    """
    cuts = settled(lambda: _cuts(docs, edits))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), tk.row_key("doc_id", "text").alias("rid"), *[whole] * carry)
    joined = keyed.join(cuts, ["doc", "rid"], "left").withColumn("out", F.arrow_udf(without_lines, "struct<n_lines:bigint,n_removed:bigint,kept:string>")("text", "cut"))
    return joined.select("doc_id", "out.n_lines", "out.n_removed", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "out.kept", *["row"] * carry)


def without_lines(text: pa.Array, cut: pa.Array) -> pa.Array:
    """Every text without the lines of its numbers, and how many lines it had and lost."""
    n_lines, n_removed, kept = [], [], []
    for value, numbers in zip(text, cut, strict=True):
        value, gone = value.as_py() or "", set(numbers.as_py() or ())
        parts = value.split("\n") if value else []
        n_lines.append(len(parts))
        n_removed.append(len(gone))
        kept.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else value)
    return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["n_lines", "n_removed", "kept"])
