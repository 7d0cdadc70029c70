"""Exact removal of repeated byte strings by column-wise suffix sorting of many documents.

A byte goes if a string of `width` bytes that covers it also starts anywhere else in the corpus.

1. Windows of `width` bytes are dealt out by content: the k-gram with the least hash in a window is
   its anchor. Windows that start about as far before their anchor share all but a few bytes, their
   core. Equal windows have equal cores, so only windows whose core occurs twice can repeat.
   Successive windows with one core form a unit, a string a little longer than a window. Keys of
   cores are counted first, then the units of repeated cores are kept; units equal throughout (by
   128 bits of hashes) are one kind.
2. A kind with copies is compared at two of its places, in pieces of up to about two windows in
   which such kinds follow each other at both places; kinds without a copy are compared with the
   other kinds of their core.
3. Pieces and cores are sorted by `column_sort`, many in one task: it inserts one symbol of each
   string in every round, from the last to the first, and updates the Burrows-Wheeler transform of
   the collection, the common prefixes of neighbours and the marks of suffixes. These are one file
   that every round reads and writes once, in sequence, in the temporary folder of the task (in memory up
   to HELD bytes); nothing outside the task reads it. Windows whose common prefix with a neighbour
   reaches `width` repeat. All that is removed is found so; copies share the finding of their kind.
4. A core with more than `most` kinds is dealt out anew by longer cores, up to whole windows, so that
   no task gets an unbounded group.

Defined results: a null text has no bytes; a text shorter than `width` loses nothing; equal rows are
copies of each other, so that all of them lose what they share; rows with null or repeated ids are
told apart by a row number; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, with_row_key
from tidemill.llm.textvec import _BYTE_VALUES, POWERS, mix

WIDTH, GRAM = 400, 64
#: Kinds of one core that are sorted in one task, and bytes of groups that are sorted at once.
MOST, TOGETHER = 4096, (1 << 16) - 1
#: Parts that the windows of one anchor are cut into; more parts have longer cores and more rows.
PARTS = 3
#: A unit's place is its first start times SPAN plus its number of further starts.
SPAN = 1 << 20
#: Bytes of the file of a sort that stay in memory.
HELD = 64 << 20
#: Bytes of a symbol, the widest first; a string is sorted in as many rounds as it has symbols.
SYMBOLS = (50, 16, 8, 4, 2, 1)
#: Values that a range minimum looks up at once.
BLOCK = 64
#: Bytes that are hashed at once; a longer text is cut into pieces that overlap by a window.
PIECE = 1 << 18


class Hashes:
    """Hashes of any substrings of some bytes, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        POWERS.grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * POWERS.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * POWERS.down[start])

    def of_all(self, n: int) -> np.ndarray:
        """Hashes of the n bytes from each place on."""
        return mix((self.sums[n:] - self.sums[:-n]) * POWERS.down[: len(self.sums) - n])


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours, by running minima within blocks from both sides."""
    count = len(values) - n + 1
    blocks = np.full(-(-len(values) // n) * n, np.iinfo(values.dtype).max, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[n - 1 : n - 1 + count])


def units(data: np.ndarray, ends: np.ndarray, width: int, gram: int, parts: int = PARTS) -> tuple[np.ndarray, ...]:
    """(key, seg, first, last): runs of window starts with one core, in texts that end at `ends`.

    key is the hash of the core, seg that of all bytes of the unit.
    """
    if len(data) < width:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    step = -(-(width - gram + 1) // parts)
    hashes = Hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = hashes.of_all(gram)
    least &= ~low
    least |= np.arange(len(least), dtype=np.uint64)
    anchors = (sliding_min(least, width - gram + 1) & low).astype(np.int32)
    starts = np.arange(len(anchors), dtype=np.int32)
    side = (anchors - starts) // np.int32(step)  # windows whose anchor lies about as far from their start have one core
    change = np.ones(len(anchors), bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | (side[1:] != side[:-1])
    edges = np.concatenate(([0], ends, ends - width + 1))  # where a text begins or its last whole window ends
    change[edges[(edges >= 0) & (edges < len(anchors))]] = True
    first = np.flatnonzero(change)
    last = np.concatenate((first[1:], [len(anchors)])) - 1
    whole = first + width <= ends[np.searchsorted(ends, first, "right")]
    first, last = first[whole], last[whole]
    a, part = anchors[first].astype(np.int64), side[first].astype(np.int64)
    core = hashes.of(a - part * step, a - part * step + width + 1 - step)
    key = mix(core + part.astype(np.uint64))
    seg = mix(hashes.of(first, last + width) + (last - first).astype(np.uint64) * np.uint64(1024) + (a - first).astype(np.uint64))
    return key, seg, first, last


def as_bytes(text: str | bytes | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text or b"")


def raw_pieces(rows: np.ndarray, texts: list, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts, joined up to about PIECE: (data, row of each text, its start in the text, ends)."""
    held, owner, offset, size = [], [], [], 0

    def joined() -> tuple:
        return np.frombuffer(b"".join(held), np.uint8), np.array(owner), np.array(offset), np.cumsum([len(h) for h in held])

    for row, text in zip(rows, texts, strict=True):
        raw = as_bytes(text)
        for at in range(0, max(1, len(raw) - width + 1), PIECE):
            part = raw[at : at + PIECE + width - 1]
            if len(part) < width:
                continue
            held.append(part)
            owner.append(row)
            offset.append(at)
            size += len(part)
            if size >= PIECE:
                yield joined()
                held, owner, offset, size = [], [], [], 0
    if held:
        yield joined()


def all_units(keyed: DataFrame, text_col: str, width: int, gram: int, parts: int, only_keys: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, owner, offset, ends in raw_pieces(batch["row"].to_numpy(), batch["text"].tolist(), width):
                key, seg, first, last = units(data, ends, width, gram, parts)
                if only_keys:
                    yield pd.DataFrame({"key": key.view(np.int64)})
                    continue
                text = np.searchsorted(ends, first, "right")
                shift = offset[text] - np.concatenate(([0], ends))[text]
                place = (first + shift) * SPAN + (last - first)
                yield pd.DataFrame({"row": owner[text], "place": place, "key": key.view(np.int64), "seg": seg.view(np.int64)})

    chosen = keyed.select(F.col("_tm_row").alias("row"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, "key bigint" if only_keys else "row bigint, place bigint, key bigint, seg bigint")


class Records:
    """An array in a file that every round reads and writes in sequence; it leaves memory when it outgrows HELD."""

    def __init__(self, values: np.ndarray) -> None:
        self.dtype, self.file = values.dtype, tempfile.SpooledTemporaryFile(max_size=HELD, prefix="column-")
        self.write(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.dtype)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(values.data)
        self.file.truncate()


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[l:h] for each range, none of them empty; long ranges go by blocks."""
    out = values[low].copy()
    padded = np.append(values, np.full(BLOCK - len(values) % BLOCK, np.iinfo(values.dtype).max, values.dtype))

    def fold(data: np.ndarray, chosen: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        down = np.argsort(-x, kind="stable")  # then what lies between two ranges is one element
        got = np.minimum.reduceat(data, np.column_stack((x[down], y[down])).ravel())[::2]
        out[chosen[down]] = np.minimum(out[chosen[down]], got)

    first, last = -(-low // BLOCK), high // BLOCK
    short, long = np.flatnonzero((first >= last) & (high - low > 1)), np.flatnonzero(first < last)
    if len(short):
        fold(padded, short, low[short], high[short])
    if len(long):
        fold(padded, long, low[long], first[long] * BLOCK + 1)
        fold(padded, long, last[long] * BLOCK - 1, high[long])
        fold(np.append(padded.reshape(-1, BLOCK).min(axis=1), values.dtype.type(0)), long, first[long], last[long])
    return out


def numbered(data: np.ndarray, wide: int) -> np.ndarray:
    """A number for the `wide` bytes from each place on, the same for the same bytes and below len(data)."""
    count = len(data) - wide + 1
    if wide > 8:
        half = -(-wide // 2)  # two strings of half the bytes that may overlap
        part = numbered(data, half)
        grams = part[:count] << 32 | part[wide - half :]
    else:
        grams = np.zeros(count, np.int64)
        for k in range(wide):
            grams = grams << 8 | data[k : k + count]
    return np.unique(grams, return_inverse=True)[1]


def symbol_table(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(table, string, phase, lengths, bytes of a symbol): the strings in wide symbols, from each of their first bytes on.

    Row j of the table holds the symbols in front of the suffixes of j symbols, 0 at the start.
    A symbol has as many bytes as divide `width` and need at most 16 bits to number what occurs.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings) + bytes(SYMBOLS[0]), np.uint8)
    for wide in (w for w in SYMBOLS if width % w == 0):
        string, phase = np.repeat(np.arange(len(strings)), wide), np.tile(np.arange(wide), len(strings))
        lengths = np.maximum(sizes[string] - phase, 0) // wide
        keep = lengths >= width // wide
        string, phase, lengths = string[keep], phase[keep], lengths[keep]
        back = np.arange(int(lengths.max(initial=0)))[:, None]
        inside = back < lengths
        code = numbered(data, wide)[(begins[string] + phase + wide * (lengths - 1 - back))[inside]]
        if code.max(initial=0) >= (1 << 16) - 1:  # it may count what occurs only across the ends of strings
            code = np.unique(code, return_inverse=True)[1]
        if code.max(initial=0) < (1 << 16) - 1:
            break
    table = np.zeros((len(back) + 1, len(string)), np.uint16)
    table[:-1][inside] = code + 1
    return table, string, phase, lengths, wide


def column_sort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every window of `width` bytes that occurs at two places in the strings.

    Round j inserts the suffixes of j symbols of all strings that are as long. The place of such a
    suffix is the rank of its first symbol in the transform so far, which a stable sort of the
    transform gives; its common prefixes with its neighbours are one more than the least common
    prefix between the places of the rests. Suffixes of whole windows are marked. A record of the
    file is mark, common prefix and symbol of the transform.
    """
    if max(map(len, strings), default=0) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, string, phase, lengths, wide = symbol_table(strings, width)
    rounds, need = len(table) - 1, width // wide
    records = Records(table[0].astype(np.int64) | np.int64(-1) << 32)
    place, alive = np.arange(len(string)), np.arange(len(string))
    for j in range(1, rounds + 1):
        old = records.read()
        fields = old.view(np.uint16).reshape(-1, 4)
        transform, common = np.ascontiguousarray(fields[:, 0]), np.ascontiguousarray(fields[:, 1])
        order = np.argsort(transform, kind="stable")
        rank = np.empty(len(old), np.int64)
        rank[order] = np.arange(len(old))
        at = place[alive]
        k, symbol = rank[at], transform[at]
        new = k + len(alive)  # zeros of ended strings come first in the order, all strings' ends in the transform
        rest = np.ones(len(old) + len(alive), bool)
        rest[new] = False
        now = np.empty(len(rest), np.int64)
        now[rest] = old
        now[new] = (alive * (rounds + 1) + j if j >= need else np.full(len(alive), -1)) << 32 | table[j, alive]
        before, after = order[k - 1], order[np.minimum(k + 1, len(old) - 1)]
        with_before = np.flatnonzero((k > 0) & (transform[before] == symbol) & (before < at))
        with_after = np.flatnonzero((k + 1 < len(old)) & (transform[after] == symbol) & (after > at))
        common_now = now.view(np.uint16).reshape(-1, 4)[:, 1]
        for chosen, low, high, where in ((with_before, before, at, new), (with_after, at, after, new + 1)):
            if len(chosen):
                common_now[where[chosen]] = np.minimum(least_between(common, low[chosen] + 1, high[chosen] + 1) + 1, need)
        records.write(now)
        place[alive] = new
        alive = alive[lengths[alive] > j]
    last = records.read()
    joined = last.view(np.uint16).reshape(-1, 4)[:, 1] >= need
    found = (last >> 32)[joined | np.append(joined[1:], False)]
    own, length = found // (rounds + 1), found % (rounds + 1)
    return string[own], phase[own] + wide * (lengths[own] - length)


def packed(keyed: DataFrame, text_col: str, *others: Column) -> DataFrame:
    """(row, blob, other columns): texts as compressed bytes, for what has to be shuffled with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            batch["blob"] = [press.compress(as_bytes(t)) for t in batch["blob"]]
            yield batch

    chosen = keyed.select(F.col("_tm_row").alias("row"), F.col(text_col).alias("blob"), *others)
    kinds = "".join(f", `{c}` {kind}" for c, kind in chosen.dtypes[2:])
    return chosen.mapInPandas(run, "row bigint, blob binary" + kinds)


def unit_bytes(keyed: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(group, raw, marks): the bytes of the wanted strings (row, list of strings by first and last start).

    marks are (key, seg, first start, number of starts) of the units in the string that ask for a
    verdict, one after the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unpack = ["group", "raw", "marks"], zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for blob, own in zip(batch["blob"], batch["strings"], strict=True):
                raw = unpack.decompress(blob)
                for u in own:
                    marks = np.array(u["marks"], np.int64)
                    marks[2::4] -= u["first"]
                    out.append((u["group"], raw[u["first"] : u["last"] + width], marks))
                    size += len(out[-1][1])
                if size >= PIECE:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    chosen = packed(keyed, text_col).join(wanted, "row").select("blob", "strings")
    return chosen.mapInPandas(run, "group bigint, raw binary, marks array<bigint>")


def sorted_matches(strings: DataFrame, tasks: int, width: int) -> DataFrame:
    """(key, seg, low, high): runs of repeated windows of marked units; a group's strings are sorted together."""

    def matches(rows: pd.DataFrame) -> pd.DataFrame:
        string, start = column_sort(rows["raw"].tolist(), width)
        begins = np.cumsum(rows["raw"].str.len().to_numpy()) - rows["raw"].str.len().to_numpy()
        found = np.sort(begins[string] + start)
        marks = np.concatenate(rows["marks"].tolist()).reshape(-1, 4)
        marks[:, 2] += np.repeat(begins, rows["marks"].str.len() // 4)
        own = np.searchsorted(marks[:, 2], found, "right") - 1  # marks stand in order of their places
        inside = (own >= 0) & (found < (marks[:, 2] + marks[:, 3])[own])
        found, own = found[inside], own[inside]
        edge = np.ones(len(found) + 1, bool)
        edge[1:-1] = (np.diff(found) > 1) | (np.diff(own) > 0)
        edges = np.flatnonzero(edge)
        low, high = edges[:-1], edges[1:] - 1
        unit = marks[own[low]]
        return pd.DataFrame({"key": unit[:, 0], "seg": unit[:, 1], "low": found[low] - unit[:, 2], "high": found[high] - unit[:, 2]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            rows = pd.concat([*rest, batch], ignore_index=True)
            groups, sizes = rows["group"].to_numpy(), np.concatenate(([0], rows["raw"].str.len().cumsum()))
            at = here = 0
            for b in np.flatnonzero(groups[1:] != groups[:-1]) + 1:  # the last group may go on
                if sizes[b] - sizes[at] > TOGETHER and here > at:
                    yield matches(rows.iloc[at:here])
                    at = here
                here = b
            rest = [rows.iloc[at:]]
        if rest and len(rest[0]):
            yield matches(rest[0])

    return strings.repartition(tasks, "group").sortWithinPartitions("group").mapInPandas(run, "key bigint, seg bigint, low bigint, high bigint")


def repeated_windows(keyed: DataFrame, text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(row, first, last): runs of starts of windows that occur elsewhere too, in a table with the key `_tm_row`."""
    # tables by key are cut before they are joined, so that the join's own shuffles can be split where a key is hot
    often = cut(all_units(keyed, text_col, width, gram, parts, only_keys=True).groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"))
    shared = cut(all_units(keyed, text_col, width, gram, parts).join(often, "key", "left_semi"))
    place = F.struct("row", "place")
    kinds = cut(shared.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(place).alias("one"), F.max(place).alias("two")))
    first, last = (lambda c: F.shiftright(c, 20)), (lambda c: F.shiftright(c, 20) + c % SPAN)
    mark = lambda c: F.array("key", "seg", first(c), c % SPAN + 1)
    no_mark = F.array().cast("array<bigint>")

    # kinds with copies: two places each, pieced together where successive kinds have them at one distance
    pairs = kinds.filter("copies > 1").select(
        "key", "seg", F.col("one.row").alias("a"), F.col("two.row").alias("b"), (first(F.col("two.place")) - first(F.col("one.place"))).alias("shift"),
        first(F.col("one.place")).alias("first"), last(F.col("one.place")).alias("last"), mark(F.col("one.place")).alias("mark"),
    )
    along = Window.partitionBy("a", "b", "shift").orderBy("first")
    opens = F.when(F.col("first") > F.coalesce(F.lag("last").over(along), F.lit(-2)) + 1, F.col("first"))
    pieces = (
        pairs.withColumn("opens", opens).withColumn("open", F.max("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("a", "b", "shift", "open", F.floor((F.col("first") - F.col("open")) / width).alias("part"))
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "mark"))), lambda m: m.mark)).alias("marks"))
        .withColumn("group", F.xxhash64("a", "b", "shift", "open", "part"))
    )
    copied = pieces.select(F.col("a").alias("row"), "group", "first", "last", "marks").union(
        pieces.select(F.col("b").alias("row"), "group", F.col("first") + F.col("shift"), F.col("last") + F.col("shift"), no_mark)
    )
    # cores with a kind of which there is no copy
    cores = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 and least = 1")
    unlike = kinds.join(cores.select("key", "kinds"), "key").select(
        F.col("one.row").alias("row"), F.col("key").alias("group"), first(F.col("one.place")).alias("first"), last(F.col("one.place")).alias("last"),
        F.when(F.col("copies") == 1, mark(F.col("one.place"))).otherwise(no_mark).alias("marks"), "kinds", mark(F.col("one.place")).alias("own"),
    )
    size = cores.agg(F.coalesce(F.max("kinds"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def strings_of(rows: DataFrame) -> DataFrame:
        per_row = rows.groupBy("row").agg(F.collect_list(F.struct("group", "first", "last", "marks")).alias("strings"))
        return unit_bytes(keyed, per_row, text_col, width)

    about = kinds.count() * 2 * (width // parts) + size[1] * (width + width // parts)
    tasks = max(4 * keyed.sparkSession.sparkContext.defaultParallelism, about >> 25)
    asked = unlike.filter(F.col("kinds") <= most).drop("kinds", "own").union(copied)
    verdicts = sorted_matches(strings_of(asked), tasks, width)
    if size[0] > most:
        named = strings_of(unlike.filter(F.col("kinds") > most).select("row", "group", "first", "last", F.col("own").alias("marks")))
        hot = cut(named.withColumn("_tm_row", F.monotonically_increasing_id()))
        again = repeated_windows(hot, "raw", width, gram, most, min(8 * parts, width - gram + 1))
        names = hot.select(F.col("_tm_row").alias("row"), F.element_at("marks", 1).alias("key"), F.element_at("marks", 2).alias("seg"))
        verdicts = verdicts.union(again.join(names, "row").select("key", "seg", F.col("first").alias("low"), F.col("last").alias("high")))
    start = first(F.col("place"))
    return shared.join(cut(verdicts), ["key", "seg"]).select("row", (start + F.col("low")).alias("first"), (start + F.col("high")).alias("last"))


def without_repeats(keyed: DataFrame, text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST, id_col: str = "_tm_row") -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): the bytes that are left of every text, under its `id_col`."""
    spans = repeated_windows(keyed, text_col, width, gram, most).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unpack = ["row", "n_bytes", "n_removed", "n_spans", "kept"], zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for name, blob, own in zip(batch["id"], batch["blob"], batch["spans"], strict=True):
                raw = unpack.decompress(blob)
                kept, removed, count, at = [], 0, 0, 0
                end = -1
                for first, last in sorted((s["first"], s["last"]) for s in (own if own is not None else ())):
                    if first > end:
                        count += 1
                        kept.append(raw[at:first])
                    removed += max(0, last + width - max(first, end))
                    at = end = max(end, last + width)
                out.append((name, len(raw), removed, count, b"".join([*kept, raw[at:]])))
                size += len(raw)
                if size >= PIECE:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    texts = packed(keyed, text_col, F.col(id_col).alias("id"))
    kind = dict(texts.dtypes)["id"]
    return texts.join(spans, "row", "left").select("id", "blob", "spans").mapInPandas(run, f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans and the kept bytes."""
    keyed = with_row_key(docs.select(id_col, text_col), id_col)
    return without_repeats(keyed, text_col, width, id_col=id_col).withColumnRenamed("row", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
