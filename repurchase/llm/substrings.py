"""Removing long repeated byte strings with a run-compressed Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else in the corpus.

1. Documents with equal text are one class. If a class has two members, all of a text of at least ``length`` bytes
   repeats; one member stands for the class towards the others.
2. Every window of ``length`` bytes names an anchor: its leftmost smallest k-byte hash. Equal windows name equal
   anchors, so only anchors that occur twice can lie in a repeated window. The stretch of an anchor is all bytes of
   the windows that name it.
3. The stretches of one anchor are a collection of strings aligned at the anchor. Their Burrows-Wheeler transform is
   built column by column to the left and held as runs: a run of equal characters is moved as a whole, and the common
   prefixes are sampled at the ends of runs. The matching statistic of a stretch at a column, the longest match of its
   suffix with any other, is the larger of the common prefixes with its two neighbours; where it reaches ``length``,
   the window that starts there repeats. A stretch whose statistic can no longer get there is dropped.
4. The repeated windows of a text are merged and cut out.

Anchors with more than ``hot`` occurrences are dealt out by their offset within the window and the bytes that all
windows of that offset share, and equal stretches are sent once per task. Where a group still has more than ``hot``
different stretches, as at the edge of a passage that many texts share, these are dealt out again by half as many
offsets, down to one: there a group is a window, and a plain count tells whether it repeats.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows and null ids are
handled row by row, and a text occurring in two rows repeats; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repurchase.llm.neardup import MIX, mixed, text_slices
from repurchase.llm.storage import stored

LENGTH = 400
GRAM = 64
HOT = 20_000
# Offsets that share a group once an anchor is hot.
CELL = 32
# Positions share a word with the hash, so that the leftmost of equal hashes wins.
PLACE_BITS = 20
PIECE_BYTES = 1 << PLACE_BITS
SLICE_BYTES = 1 << 19
STRETCH_BYTES = 8 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (8 times a power of two) bytes from every position that has so many."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    raw = data.tobytes()
    h = np.empty(n, dtype=np.uint64)
    for o in range(8):
        count = (len(raw) - o) // 8
        h[o::8] = np.frombuffer(raw, dtype="<u8", count=count, offset=o)
    h = mixed(h + MIX[0])
    width = 8
    while width < gram:
        if len(h) <= width:
            return np.zeros(0, dtype=np.uint64)
        h = mixed(h[:-width] * MIX[1] + h[width:])
        width *= 2
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, hash) of texts lying one after the other; places within each text."""
    h = gram_hashes(data, gram)
    bits = np.uint64(PLACE_BITS)
    lowest = window_minima((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(lowest)]
    starts = np.flatnonzero(np.arange(len(lowest)) + length <= offsets[owner + 1])
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, np.zeros(0, dtype=np.uint64)
    at = (lowest[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = owner[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    base = offsets[text[new]]
    return text[new], at[new] - base, starts[new] - base, starts[last] - base, h[at[new]]


def anchors(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE_BYTES) -> DataFrame:
    """body, piece, hash, n, places (array of anchor, first, last), for every text of at least ``length`` bytes.

    The anchors of a text that share a hash are one row: a text that repeats a few words has thousands. A text of at
    least ``piece`` bytes (more than ``length``, at most 2 ** PLACE_BITS) has such rows for each of its pieces, named
    by the place where the piece begins; a window belongs to one piece only.
    """
    place = pa.struct([("anchor", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
    names = ["body", "piece", "hash", "n", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, data, offsets in text_slices(batch, "_text", min(SLICE_BYTES, piece - 1)):
                    bodies = batch.column("body")[i:j]
                    # A very long text goes piece by piece; pieces overlap by all but one byte of a window.
                    step = piece - length
                    for at in range(0, max(len(data) - length + 1, 1), step):
                        part = data[at : at + step + length - 1]
                        bounds = offsets if len(offsets) > 2 else np.array([0, len(part)])
                        text, anchor, first, last, h = anchors_of(part, bounds, length, gram)
                        order = np.lexsort((h, text))
                        text, h = text[order], h[order]
                        heads = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
                        ends = np.concatenate([heads, [len(h)]]).astype(np.int32)
                        three = [pa.array((c[order] + at).astype(np.int32)) for c in (anchor, first, last)]
                        places = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(three, fields=list(place)))
                        begun = pa.array(np.full(len(heads), at, dtype=np.int32))
                        columns = [bodies.take(pa.array(text[heads])), begun, pa.array(h[heads].view(np.int64)), pa.array(np.diff(ends), pa.int64()), places]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents.select("body", "_text").where(F.octet_length("_text") >= length)
    return rows.mapInArrow(run, "body binary, piece int, hash long, n long, places array<struct<anchor:int,first:int,last:int>>")


def stretches(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """group, stretch (digest), place (of the anchor in it), body, at (where it begins), bytes (null if sent before).

    ``texts`` has body, _text and anchors: an array of (hash, n, places), where the pieces of a text repeat a hash.
    """
    names = ["group", "stretch", "place", "size", "body", "at", "bytes"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            for n in range(batch.num_rows):
                raw, body, rows = batch.column("_text")[n].as_py().encode(), batch.column("body")[n].as_py(), []
                for a, is_hot in ((p | {"hash": g["hash"]}, g["n"] > hot) for g in batch.column("anchors")[n].as_py() for p in g["places"]):
                    p, cells = a["anchor"], [(a["first"], a["last"], a["hash"])]
                    if is_hot:
                        cells = []
                        for cell in range((p - a["last"]) // CELL, (p - a["first"]) // CELL + 1):
                            low, high = max(a["first"], p - CELL * cell - CELL + 1), min(a["last"], p - CELL * cell)
                            known = raw[p - CELL * cell : p - CELL * cell - CELL + 1 + length]
                            name = hashlib.blake2b(known, digest_size=8, salt=(a["hash"] & (1 << 64) - 1).to_bytes(8, "little"), person=cell.to_bytes(4, "little")).digest()
                            cells.append((low, high, int.from_bytes(name, "little", signed=True)))
                    for first, last, group in cells:
                        piece = raw[first : last + length]
                        digest = hashlib.blake2b(piece, digest_size=16).digest()
                        known = (group, digest) in sent
                        if not known:
                            sent.add((group, digest))
                        rows.append((group, digest, p - first, len(piece), body, first, None if known else piece))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                if len(sent) > 500_000:
                    sent.clear()

    return texts.select("body", "_text", "anchors").mapInArrow(run, "group long, stretch binary, place int, size int, body binary, at int, bytes binary")


def finer(found: DataFrame, length: int, cell: int) -> DataFrame:
    """``stretches`` within the given ones, by cells of ``cell`` offsets: outer_group and outer_stretch instead of body,
    and ``at`` counts from the beginning of the outer stretch."""
    names = ["group", "stretch", "place", "size", "outer_group", "outer_stretch", "at", "bytes"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            rows = []
            for group, stretch, p, raw in zip(*(batch.column(c).to_pylist() for c in ("group", "stretch", "place", "bytes"))):
                # A window that begins d bytes before the anchor is in cell d // cell.
                for c in range(max(p - len(raw) + length, 0) // cell, p // cell + 1):
                    first, last = max(0, p - cell * c - cell + 1), min(len(raw) - length, p - cell * c)
                    known = raw[p - cell * c : p - cell * c - cell + 1 + length]
                    name = hashlib.blake2b(known, digest_size=8, salt=(group & (1 << 64) - 1).to_bytes(8, "little"), person=c.to_bytes(4, "little")).digest()
                    inner, piece = int.from_bytes(name, "little", signed=True), raw[first : last + length]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    known_piece = (inner, digest) in sent
                    if not known_piece:
                        sent.add((inner, digest))
                    rows.append((inner, digest, p - first, len(piece), group, stretch, first, None if known_piece else piece))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            if len(sent) > 500_000:
                sent.clear()

    kept = found.select("group", "stretch", "place", "bytes")
    return kept.mapInArrow(run, "group long, stretch binary, place int, size int, outer_group long, outer_stretch binary, at int, bytes binary")


def repeated_windows(groups: np.ndarray, places: np.ndarray, strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the places where its first repeated window begins and its last one ends (-1: none).

    Strings of one group are aligned at their ``places``. ``groups`` is sorted, and no string occurs twice in one.
    """
    m = len(strings)
    begin, end = np.full(m, -1), np.full(m, -1)
    tails = [s[p : p + length] for s, p in zip(strings, places.tolist())]
    order = np.array(sorted(range(m), key=lambda i: (groups[i], tails[i])), dtype=np.int64)
    # Common prefixes of neighbours.
    sizes = np.array([len(t) for t in tails])
    common = np.zeros(m, dtype=np.int64)
    for at in range(0, m - 1, 8192):
        upto = min(at + 8192, m - 1)
        rows = np.zeros((upto - at + 1, length), dtype=np.uint8)
        for k in range(upto - at + 1):
            t = tails[order[at + k]]
            rows[k, : len(t)] = np.frombuffer(t, dtype=np.uint8)
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        common[at + 1 : upto + 1] = np.minimum(first, np.minimum(sizes[order[at + 1 : upto + 1]], sizes[order[at:upto]]))
    same = groups[order][1:] == groups[order][:-1]
    common[1:][~same] = 0
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    anchor = np.concatenate([[0], np.cumsum([len(s) for s in strings])[:-1]]) + places
    column = 0
    while len(order) > 1:
        # The matching statistic of each row; record where it reaches the length.
        best = np.maximum(common, np.concatenate([common[1:], [0]]))
        hit = order[best >= length]
        begin[hit] = places[hit] - column
        fresh = hit[end[hit] < 0]
        end[fresh] = places[fresh] - column + length
        # A row needs a character before it, and enough of them to reach the length.
        keep = np.flatnonzero((places[order] > column) & (best + places[order] - column >= length))
        if len(keep) < 2:
            break
        if len(keep) < len(order):
            common = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            common[0] = 0
            order = order[keep]
        group, char = groups[order], flat[anchor[order] - column - 1]
        heads = np.flatnonzero(np.concatenate([[True], (char[1:] != char[:-1]) | (group[1:] != group[:-1])]))
        counts = np.diff(np.concatenate([heads, [len(order)]]))
        # Runs are sorted by character, keeping their order otherwise; this is the step to the preceding column.
        run_group, run_char = group[heads], char[heads]
        runs = np.lexsort((np.arange(len(heads)), run_char, run_group))
        at_end = common[heads]
        lowest = np.minimum.reduceat(common, heads)
        joined = np.concatenate([[False], (run_group[runs][1:] == run_group[runs][:-1]) & (run_char[runs][1:] == run_char[runs][:-1])])
        border = np.zeros(len(runs), dtype=np.int64)
        if joined.any():
            # Between two runs of one character, the least of all samples in between counts.
            j = np.flatnonzero(joined)
            x, y = runs[j - 1], runs[j]
            pairs = np.stack([x + 1, y], axis=1).ravel()
            least = np.minimum.reduceat(np.append(lowest, 0), pairs)[::2]
            border[j] = np.minimum(least, at_end[y]) + 1
        begins = np.concatenate([[0], np.cumsum(counts[runs])[:-1]])
        index = np.repeat(heads[runs] - begins, counts[runs]) + np.arange(len(order))
        order, common = order[index], common[index] + 1
        common[begins] = border
        column += 1
    return begin, end


def matches(found: DataFrame, length: int) -> DataFrame:
    """group, stretch, begin, end: the repeated part of each distinct stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            groups = np.array([r[0] for r in rows], dtype=np.int64)
            begin, end = repeated_windows(groups, np.array([r[2] for r in rows], dtype=np.int64), [r[3] for r in rows], length)
            keep = np.flatnonzero(begin >= 0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(groups[keep]), pa.array([rows[i][1] for i in keep], pa.binary()),
                    pa.array(begin[keep], pa.int32()), pa.array(end[keep], pa.int32()),
                ],
                names=["group", "stretch", "begin", "end"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "stretch", "place", "bytes"))):
                if held and row[0] == held[-1][0] and row[1] == held[-1][1]:
                    continue
                if held and row[0] != held[-1][0] and size >= STRETCH_BYTES:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    sent = found.where("bytes is not null").select("group", "stretch", "place", "bytes")
    return sent.repartition("group").sortWithinPartitions("group", "stretch").mapInArrow(run, "group long, stretch binary, begin int, end int")


def repeated_parts(found: DataFrame, length: int, hot: int, cell: int = CELL) -> DataFrame:
    """group, stretch, begin, end: the repeated parts of each distinct stretch; ``found`` is read several times."""
    # A stretch that lies at two places repeats as a whole.
    whole = (
        found.groupBy("group", "stretch")
        .agg(F.count("*").alias("n"), F.max("size").alias("end"))
        .where("n > 1")
        .select("group", "stretch", F.lit(0).alias("begin"), "end")
    )
    if cell == 1:
        # Every stretch is a window.
        return whole
    many = stored(found.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("group"), "many")
    if many.isEmpty():
        return whole.unionByName(matches(found, length))
    distinct = found.join(many, "group", "left_semi").select("group", "stretch").distinct()
    large = stored(distinct.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("group"), "large")
    if large.isEmpty():
        return whole.unionByName(matches(found, length))
    # One row per stretch; the bytes were sent at least once.
    apart = found.where("bytes is not null").join(large, "group", "left_semi").dropDuplicates(["group", "stretch"])
    inner = stored(finer(apart, length, cell // 2), "finer")
    parts = repeated_parts(inner, length, hot, cell // 2)
    spans = inner.select("group", "stretch", "outer_group", "outer_stretch", "at").join(parts, ["group", "stretch"])
    spans = spans.select(
        F.col("outer_group").alias("group"), F.col("outer_stretch").alias("stretch"),
        (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end"),
    )
    return whole.unionByName(matches(found.join(large, "group", "left_anti"), length)).unionByName(spans)


def cut(texts: DataFrame) -> DataFrame:
    """body, _text, spans (array of begin, end) -> body, n_removed, n_spans, kept_sha256, kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n in range(batch.num_rows):
                raw = batch.column("_text")[n].as_py().encode()
                at, removed, runs, kept = 0, 0, 0, []
                for s in sorted((s["begin"], s["end"]) for s in batch.column("spans")[n].as_py()):
                    if s[0] > at or not runs:
                        kept.append(raw[at : s[0]])
                        runs += 1
                        at = s[0]
                    removed += max(0, s[1] - at)
                    at = max(at, s[1])
                kept = b"".join([*kept, raw[at:]])
                rows.append((batch.column("body")[n].as_py(), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["body", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "body binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_strings(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep_bytes: bool = False, piece: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` kept: what is left of the text."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("_text"), F.unhex(F.md5(text)).alias("body"), F.octet_length(text).cast("long").alias("n_bytes"))
    classes = rows.where(F.col("n_bytes") >= length).groupBy("body").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    classes = stored(classes, "classes")
    named = stored(anchors(rows, length, gram, piece), "anchors")
    # An anchor is a candidate if it occurs at two places of a text, in one piece or in two, or in two different texts.
    # The table of candidates is stored, as adaptive execution splits hot keys only in a join of two plain exchanges.
    text_id = F.xxhash64("body")
    twice = (
        named.groupBy("hash")
        .agg(
            F.min(text_id).alias("low"), F.max(text_id).alias("high"), F.sum("n").alias("all"),
            F.min(F.array_min("places.anchor")).alias("leftmost"), F.max(F.array_max("places.anchor")).alias("rightmost"),
        )
        .where("low != high or leftmost != rightmost")
        .select("hash", "all")
    )
    candidates = named.join(stored(twice, "twice"), "hash")
    # Rows that repeat a text have equal places piece by piece.
    once = candidates.groupBy("body", "hash", "piece").agg(F.max("all").alias("n"), F.first("places").alias("places"))
    grouped = once.groupBy("body").agg(F.collect_list(F.struct("hash", "n", "places")).alias("anchors"))
    chosen = grouped.join(classes, "body").select(F.coalesce("rep", F.lit(-1)).alias("_doc"), "body", "anchors")
    texts = rows.where(F.col("n_bytes") >= length).select(F.coalesce("doc_id", F.lit(-1)).alias("_doc"), "body", "_text")
    texts = stored(texts.join(chosen, ["_doc", "body"]).dropDuplicates(["_doc", "body"]).drop("_doc"), "texts")
    found = stored(stretches(texts, length, hot), "stretches")
    parts = repeated_parts(found, length, hot)
    spans = found.select("group", "stretch", "body", "at").join(parts, ["group", "stretch"])
    spans = spans.groupBy("body").agg(F.collect_list(F.struct((F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end"))).alias("spans"))
    copied = classes.where("copies > 1").select("body")
    partly = cut(texts.select("body", "_text").join(spans, "body").join(copied, "body", "left_anti"))
    partly = partly if keep_bytes else partly.drop("kept")
    entire = copied.select("body", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"))
    if keep_bytes:
        entire = entire.withColumn("kept", F.lit(b"").cast("binary"))
    result = partly.unionByName(entire)
    own = rows.select("doc_id", "body", "n_bytes", F.sha2("_text", 256).alias("sha"), *([F.col("_text").cast("binary").alias("raw")] if keep_bytes else []))
    joined = own.join(result, "body", "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    out = [
        "doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    ]
    return joined.select(*out, *([F.coalesce("kept", "raw").alias("kept")] if keep_bytes else []))
