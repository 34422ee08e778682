"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts anywhere else.

Texts are UTF-8 bytes and matches never cross texts. The suffix order that finds the matches is built
column by column over collections of text pieces: every round inserts one symbol per piece, and updates
the order of the pieces (the collection's Burrows-Wheeler column is the symbols in that order) and the
common prefix of neighbours; a neighbour with ``length`` common bytes is a match. Column-wise insertion over
whole texts takes as many rounds as the longest text has bytes, each over all of the transform built so
far, so it runs over pieces instead, which Spark deals out such that equal strings meet, aligned:

1. Every window of ``length`` bytes has an anchor: its leftmost 64-byte string of smallest hash. Windows
   of one anchor are neighbours and form a run; equal windows have equal anchors at equal offsets. A
   text has a run per about 130 bytes, and only runs (hashes and places) are shuffled.
2. Runs are counted by (anchor hash, context hash), map-side combined. A run whose anchor occurs once
   has no match. A run whose whole context occurs again is covered: this settles copies and the inside of
   shared passages, also where a group of copies holds a third of all rows.
3. What is left are the ends of shared passages and near copies: one run per distinct context of anchors
   with several. Their windows are taken in blocks of ``BLOCK`` neighbours and counted in the same way, by the
   bytes that all windows of the block share: a block is settled like a run, so only the few blocks stay
   open in which a match begins or ends.
4. The pieces of open blocks that share an anchor and those bytes go into collections of bounded size, and
   the column-wise construction finds the matching windows in ``length`` + ``BLOCK`` rounds. All pieces are aligned
   at their anchor, so the order per column is enough.
5. Groups with more than ``GROUP_ROWS`` distinct pieces are not gathered: their windows are hashed (128 bits),
   counted map-side combined, and joined back. This is exact too and linear in the rows.

Hashes are 128 bits (anchor and context); equality of windows in step 4 is by bytes.

By words: with ``words``, a string is that many words in a row, whatever the bytes and the white space between them. A text is then read as the
64-bit hashes of its words, 8 bytes each, on which all of the above runs with a length of 8 bytes a word; matches at other places than the
beginning of a hash are as likely as equal hashes of different words. What goes is the text from a run's first word to its last.
No group, text or match list is gathered but the pieces of one collection and the spans of one text.

Defined cases: null texts count as empty; texts under ``length`` bytes keep every byte; repeated rows are
each other's matches; doc_id may be null or repeated (texts are identified by their MD5); other columns pass
through (those named as an output are replaced; ``spans`` and names that begin with ``sd_`` are reserved). Removed bytes may cut a UTF-8 character: the text drops the broken rest of such a character, the digests
are of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import binary_texts, bound_batches, emptied, stored
from cohortkit.llm.hashing import BASE, IS_SPACE, mix, word_hashes
from cohortkit.llm.passages import Hashes, anchors

LENGTH = 400
BLOCK = 16
GROUP_ROWS = 256
COLLECTION_ROWS = 512


def matching_windows(pieces: list[np.ndarray], at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, whether the window that starts at each of its bytes stands elsewhere too.

    ``at`` is the place of the anchor in each piece. Column-wise construction from the right: ``order`` holds the
    pieces by their bytes from the column on, ``common`` the common prefix with the piece before (at most
    ``length``).
    """
    size = np.array([len(p) for p in pieces])
    first = at.max() - at  # column of each piece's first byte
    last = first + size  # column behind its last byte
    columns = int(last.max())
    cells = np.zeros((columns, len(pieces)), np.uint8)  # vertical: a round reads one row
    for k, p in enumerate(pieces):
        cells[first[k]:last[k], k] = p
    found = [np.zeros(n, bool) for n in size]
    by_end = np.argsort(-last, kind="stable")
    ends, entered = last[by_end], 0
    order, common = np.empty(0, np.int64), np.empty(0, np.int64)
    for column in range(columns - 1, -1, -1):
        upto = int(np.searchsorted(-ends, -column))  # pieces that end behind this column
        if upto > entered:  # they enter as empty strings, before all others
            order = np.concatenate([by_end[entered:upto], order])
            common = np.concatenate([np.zeros(upto - entered, np.int64), common])
            entered = upto
        gone = first[order] > column
        if gone.any():  # pieces that began to the right leave; common prefixes close up over them
            kept = np.flatnonzero(~gone)
            if not len(kept):
                order, common = order[:0], common[:0]
                continue
            common = np.minimum.reduceat(common[:kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
            order = order[kept]
        symbols = cells[column, order]  # the transform's column
        rank = np.argsort(symbols, kind="stable")
        ordered = symbols[rank]
        least = np.minimum.reduceat(
            np.append(common, 0), np.column_stack([rank[:-1] + 1, rank[1:] + 1]).reshape(-1))[::2] if len(rank) > 1 else common[:0]
        same = ordered[1:] == ordered[:-1]
        common = np.concatenate([[0], np.where(same, np.minimum(least + 1, length), 0)])
        order = order[rank]
        full = common >= length
        hit = full | np.append(full[1:], False)
        for k in order[hit]:
            found[k][column - first[k]] = True
    return found


def spans(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[from, to) of the bytes covered by the flagged windows, one per run of windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def covered(text: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


WORD_BYTES = 8


def word_symbols(text: bytes) -> bytes:
    """The hashes of the words in a row, ``WORD_BYTES`` each."""
    return word_hashes(text).tobytes()


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    inside = ~IS_SPACE[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def words_covered(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of runs of :func:`word_symbols`, from a run's first word to its last."""
    start, end = word_places(text)
    words = [(-(-a // WORD_BYTES), b // WORD_BYTES) for a, b in runs]
    return [(int(start[a]), int(end[b - 1])) for a, b in words if b > a]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def text_key(text):
    """MD5 of the text as 16 bytes (a Column); the null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def window_runs(docs: DataFrame, length: int, symbols=bytes) -> DataFrame:
    """(doc_id, sd_key, at, low, high, gram, ctx): the runs of windows of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            found = [anchors(symbols(t or b""), length) for t in binary_texts(batch.column(2))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]), pa.int64())
            cols = [np.concatenate([x[k] for x in found]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows)] + [_long(c) for c in cols],
                names=["doc_id", "sd_key", "at", "low", "high", "gram", "ctx"])

    return docs.select("doc_id", "sd_key", "text").mapInArrow(
        run, "doc_id long, sd_key binary, at long, low long, high long, gram long, ctx long")


def settle(rows: DataFrame, group: list[str], whole: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` by counting: those whose ``whole`` occurs again in its group, and one row per distinct
    ``whole`` (with ``contexts``, their number) of the groups that have several. Groups of one row go.

    ``mark`` tells rows apart, so the choice of the one row is a join without a hot key.
    """
    counts = stored(rows.groupBy(*group, whole).agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("mark")), f"{name}-counts")
    per_group = counts.groupBy(*group).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contexts")).where("rows > 1")
    judged = stored(counts.join(per_group, group).select(*group, whole, "n", "mark", "contexts"), f"{name}-judged")
    sure = rows.join(judged.where("n > 1").select(*group, whole), [*group, whole])
    still = rows.join(judged.where("contexts > 1").drop("n"), [*group, whole, "mark"])
    return sure, still


def pieces_of(docs: DataFrame, open_runs: DataFrame, length: int, symbols=bytes) -> DataFrame:
    """(gram, sd_key, low, at, data): the bytes of each open run; ``at`` is relative to ``low``."""
    per_text = open_runs.groupBy("doc_id", "sd_key").agg(F.collect_list(F.struct("gram", "at", "low", "high")).alias("runs"))
    joined = docs.select("doc_id", "sd_key", "text").join(
        per_text.withColumnRenamed("doc_id", "d").withColumnRenamed("sd_key", "k"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sd_key") == F.col("k"))).select("sd_key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            out = []
            for key, text, runs in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), batch.column(2).to_pylist()):
                text = symbols(text)
                out += [(r["gram"], key, r["low"], r["at"] - r["low"], text[r["low"]:r["high"] + length]) for r in runs]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)],
                                             names=["gram", "sd_key", "low", "at", "data"])

    return joined.mapInArrow(run, "gram long, sd_key binary, low long, at long, data binary")


def window_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """(gram, block, core, whole, sd_key, low, first, last, mark): the windows of each piece in blocks by their
    distance to the anchor. ``first`` .. ``last`` are window starts relative to ``low``; ``core`` hashes the bytes that all
    windows of such a block have, ``whole`` the bytes of the block's windows here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            parts, rows = [], []
            for k, (at, data) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                hashes = Hashes(np.frombuffer(data, np.uint8))
                top = len(data) - length  # the last window's start; distances to the anchor are at - start
                block = np.arange((at - top) // BLOCK, at // BLOCK + 1)
                first = np.maximum(at - block * BLOCK - BLOCK + 1, 0)
                last = np.minimum(at - block * BLOCK, top)
                core_from, core_to = at - block * BLOCK, at - block * BLOCK - BLOCK + 1 + length
                # inside every window of the block, so inside the piece
                core = hashes.of(core_from, core_to)
                whole = hashes.of(first, last + length) ^ mix(((at - first) * length + (at - last)).astype(np.uint64))
                parts.append((block, core.view(np.int64), whole.view(np.int64), first, last))
                rows += [k] * len(block)
            cols = [np.concatenate([p[c] for p in parts]) for c in range(5)]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), batch.column(2).take(taken)]
                + [pa.array(c, pa.int64()) for c in cols],
                names=["gram", "sd_key", "low", "block", "core", "whole", "first", "last"])

    found = pieces.select("gram", "sd_key", "low", "at", "data").mapInArrow(
        run, "gram long, sd_key binary, low long, block long, core long, whole long, first long, last long")
    return found.withColumn("mark", F.xxhash64("sd_key", "low", "first"))


def collection_spans(pieces: DataFrame, length: int, rows: int) -> DataFrame:
    """(sd_key, from, to) by the column-wise construction over collections of about ``rows`` pieces."""
    n = max(1, -(-pieces.count() // rows))
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("gram", "block", "core"), F.lit(n)).cast("int"))
    dealt = dealt.repartition(F.col("bin")).sortWithinPartitions("bin").select("bin", "sd_key", "low", "at", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def flush() -> pa.RecordBatch:
            data = [np.frombuffer(r[4], np.uint8) for r in held]
            found = matching_windows(data, np.array([r[3] for r in held]), length)
            out = [(r[1], r[2] + a, r[2] + b) for r, f in zip(held, found) for a, b in spans(f, length)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in ((0, pa.binary()), (1, pa.int64()), (2, pa.int64()))],
                names=["sd_key", "from", "to"])

        for batch in emptied(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != current:
                    if held:
                        yield flush()
                    current, held = row[0], []
                held.append(row)
        if held:
            yield flush()

    return dealt.mapInArrow(run, "sd_key binary, from long, to long")


def counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(sd_key, from, to) by counting the hashes of all windows: for groups with many pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            for key, low, data in zip(*[c.to_pylist() for c in batch.columns]):
                hashes = Hashes(np.frombuffer(data, np.uint8))
                start = np.arange(len(data) - length + 1)
                one = hashes.of(start, start + length)
                # a second hash, from the parts of the window
                two = mix(hashes.of(start, start + length // 2) * BASE + hashes.of(start + length // 3, start + length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(start), pa.binary()), _long(start + low), _long(one), _long(two)],
                    names=["sd_key", "from", "one", "two"])

    windows = stored(pieces.select("sd_key", "low", "data").mapInArrow(
        run, "sd_key binary, from long, one long, two long"), "suffix-windows")
    again = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.join(again, ["one", "two"]).select("sd_key", "from", (F.col("from") + length).alias("to"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS,
                   collection_rows: int = COLLECTION_ROWS, symbols=bytes) -> DataFrame:
    """(sd_key, spans): the covered spans of each text that has some. ``docs``: (doc_id, sd_key, text); ``symbols`` gives the
    bytes that a text is read as."""
    bound_batches(docs.sparkSession)
    runs = stored(window_runs(docs, length, symbols).withColumn("mark", F.xxhash64("doc_id", "sd_key", "low")), "suffix-runs")
    sure, still = settle(runs, ["gram"], "ctx", "suffix-runs")
    covered_runs = sure.select("sd_key", F.col("low").alias("from"), (F.col("high") + length).alias("to"))
    pieces = stored(pieces_of(docs, still, length, symbols), "suffix-pieces")
    blocks = stored(window_blocks(pieces, length), "suffix-blocks")
    sure, still = settle(blocks, ["gram", "block", "core"], "whole", "suffix-blocks")
    covered_blocks = sure.select("sd_key", (F.col("low") + F.col("first")).alias("from"), (F.col("low") + F.col("last") + length).alias("to"))
    cut = stored(
        still.join(pieces.select("gram", "sd_key", "low", "at", "data"), ["gram", "sd_key", "low"])
        .select("gram", "block", "core", "contexts", "sd_key", (F.col("low") + F.col("first")).alias("low"),
                (F.col("at") - F.col("first")).alias("at"),
                F.substring("data", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + length).cast("int")).alias("data")),
        "suffix-open")
    found = (
        covered_runs.unionByName(covered_blocks)
        .unionByName(collection_spans(cut.where(F.col("contexts") <= group_rows), length, collection_rows))
        .unionByName(counted_spans(cut.where(F.col("contexts") > group_rows), length))
    )
    return found.groupBy("sd_key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                 group_rows: int = GROUP_ROWS, collection_rows: int = COLLECTION_ROWS, keep_text: bool = True,
                 words: int | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256; ``text`` without the covered bytes (or, with
    ``keep_text`` false, left out). With ``words``, strings of so many words instead of ``length`` bytes. A column of
    ``docs`` with such a name is replaced."""
    symbols = bytes if words is None else word_symbols
    length = length if words is None else words * WORD_BYTES
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    names = [f.name for f in added]
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("sd_key"), F.col(text).alias("text"))
    found = stored(repeated_spans(keyed, length, group_rows, collection_rows, symbols), "suffix-spans")
    reserved = (text, "sd_text", "sd_of", "sd_key", "spans")
    rest = [f for f in docs.schema.fields if f.name not in (*reserved, *names)]
    joined = (
        docs.select(F.col(f"`{text}`").alias("sd_text"), *[F.col(f"`{f.name}`") for f in rest])
        .withColumn("sd_of", text_key(F.col("sd_text")))
        .join(found, F.col("sd_of") == F.col("sd_key"), "left")
        .select("sd_text", "spans", *[F.col(f"`{f.name}`") for f in rest])
    )
    schema = T.StructType(rest + ([T.StructField(text, T.StringType())] if keep_text else []) + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            out = []
            for value, marks in zip(binary_texts(batch.column(0)), batch.column(1).to_pylist()):
                data = value or b""
                runs = covered(data, [(m["from"], m["to"]) for m in marks or []])
                if words is not None:
                    runs = words_covered(data, runs)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                whole = None if value is None else left.decode("utf-8", "ignore")
                out.append((whole, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            cols = [batch.column(k + 2) for k in range(len(rest))]
            if keep_text:
                cols.append(pa.array([r[0] for r in out], pa.string()))
            cols += [pa.array([r[k] for r in out], pa.int64()) for k in (1, 2, 3)] + [pa.array([r[4] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)
