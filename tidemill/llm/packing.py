"""Best-fit packing of token sequences by bin completion.

Documents become token ids (tokenizer file by parameter) with an end id; only documents longer than
a sequence are cut, into full pieces and a rest. What is to be packed is then fully described by the
histogram of piece lengths, which has no more entries than a sequence has tokens however large the
corpus is. The driver packs that histogram: best-fit decreasing gives the incumbent, and a branch
and bound search completes one bin after the other around the largest piece left, trying the
undominated fillings by rising waste and giving up where the waste proves that the incumbent can't
be beaten. The result is a list of patterns with multiplicities; pieces get their places by their
rank among the pieces of their length, which is counted in salted parts.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed
each for itself; pieces of one length are interchangeable and ordered by a hash of id and piece; an
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut
from tidemill.llm.textvec import LOWER, run_hashes

CAPACITY = 2048
#: Parts in which the ranks within one length are counted.
PARTS = 64
#: Texts on which the rules of `ChunkEncoder` are tried.
PROBES = ("The quick, brown. Fox", "NAÏVE Straße.", "a  b\nc", "x1 3.14, (no) we'll e-mail 日本語, ok.", " lead and trail ", "ends,", "Été ÷ 2×3 ÀÞß…¿qué? a..b $5% <b>\t42nd")


#: Classes of bytes: white space, letters, digits, marks, and what makes a chunk be encoded whole.
SPACE, LETTER, DIGIT, MARK, WHOLE = range(5)
_CLASS = np.array([LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SPACE if c in b" \t\n\x0b\x0c\r" else MARK if 33 <= c < 127 and c not in b"'<" else WHOLE for c in range(128)] + [WHOLE] * 128, np.uint8)
_LOWER = np.frombuffer(LOWER, np.uint8)


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of a text, starts and ends of what is encoded for itself, and which of these are letters only.

    Between blanks, runs of letters (ASCII and those of two bytes that begin with C3), single digits and runs of marks; a chunk
    with any other byte is one unit.
    """
    kind, low = _CLASS[data], _LOWER[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    second = data[pair + 1]
    fits = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    pair, second = pair[fits], second[fits]
    kind[pair] = kind[pair + 1] = LETTER
    low[pair + 1] = np.where(second <= 0x9E, second + 0x20, second)
    full = kind != SPACE
    before = np.concatenate(([SPACE], kind[:-1]))
    chunk = np.cumsum(full & (before == SPACE)) - 1
    odd = np.zeros(int(chunk[-1]) + 2 if len(chunk) else 1, bool)
    odd[chunk[kind == WHOLE]] = True
    starts = full & ((before == SPACE) | (~odd[chunk] & ((kind != before) | (kind == DIGIT))))
    begins = np.flatnonzero(starts)
    after = np.concatenate((~full[1:], [True])) if len(full) else full
    stops = np.flatnonzero(full & (after | np.concatenate((starts[1:], [True])))) + 1 if len(full) else begins
    return low, begins, stops, (kind[begins] == LETTER) & ~odd[chunk[begins]]


class Ids:
    """Ids by hash of a unit, in arrays, within a budget of bytes: what was not used for longest goes, half of all at once."""

    def __init__(self, most_bytes: int) -> None:
        self.most = most_bytes
        self.keys, self.first, self.many, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.clock = np.zeros(0, np.uint32), 0

    @property
    def bytes(self) -> int:
        return len(self.keys) * 24 + self.pool.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where unknown."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def add(self, keys: np.ndarray, found: list[np.ndarray]) -> None:
        many = np.array([len(x) for x in found], np.int32)
        first = len(self.pool) + np.cumsum(many) - many
        self.pool = np.concatenate([self.pool, *found])
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        grown = lambda old, new: np.insert(old, place, new[order].astype(old.dtype))
        self.first, self.many, self.used = grown(self.first, first), grown(self.many, many), grown(self.used, np.full(len(keys), self.clock))
        self.keys = grown(self.keys, keys)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, in turn, and how many each has."""
        many = self.many[at].astype(np.int64)
        ends = np.cumsum(many)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + many, many)], many

    def age(self) -> None:
        self.clock += 1
        if self.bytes > self.most:
            keep = np.flatnonzero(self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
            keep = keep[-(len(self.used) // 2) :] if len(keep) == len(self.used) else keep
            pool, _ = self.gather(keep)
            self.keys, self.many, self.used, self.pool = self.keys[keep], self.many[keep], self.used[keep], pool
            self.first = np.cumsum(self.many, dtype=np.int64) - self.many


class ChunkEncoder:
    """Encodes whole texts unit by unit, remembering units seen before by 64 bits of hash.

    The tokenizer lower-cases, splits at white space, and parts letters, single digits and marks from each other before it
    merges anything, so that the ids of a text are those of its units in turn. New words are encoded together, with a
    digit between them. A tokenizer for which that does not hold on `PROBES` encodes whole texts instead.
    """

    def __init__(self, path: str, most_bytes: int = 64 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.known, self.whole = Ids(most_bytes), False
        self.whole = any(self.encode([p])[0].tobytes() != self.alone(p).tobytes() for p in PROBES)

    def alone(self, chunk: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4")

    def learn(self, new: list[str], letters: np.ndarray) -> list[np.ndarray]:
        """The ids of units; those of words are found together."""
        found: dict[int, np.ndarray] = {}
        words = np.flatnonzero(letters)
        if len(self.between) == 1 and len(words) > 1:
            ids = np.array(self.tokenizer.encode_batch_fast([" 0 ".join([new[k] for k in words])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.between[0])
            if len(cuts) == len(words) - 1:
                at = np.concatenate(([-1], cuts, [len(ids)]))
                found = {int(k): ids[a + 1 : b] for k, a, b in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True)}
        return [found[k] if k in found else self.alone(w) for k, w in enumerate(new)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; what is new in any of them is learned together."""
        if self.whole or not texts:
            return [self.alone(t) for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        low, starts, ends, letters = units(data)
        keys, first, inverse = np.unique(run_hashes(low, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.known.find(keys) < 0)
        if len(new):
            flat = low.tobytes()
            named = [flat[starts[k] : ends[k]].decode("utf-8", "surrogatepass") for k in first[new]]
            self.known.add(keys[new], self.learn(named, letters[first[new]]))
        at = self.known.find(keys)
        self.known.used[at] = self.known.clock
        ids, many = self.known.gather(at[inverse])
        self.known.age()
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        counts = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(starts, text_ends)]
        return np.split(ids, counts[:-1])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ChunkEncoder:
    """The encoder of a worker process, which goes from task to task within its budget of bytes."""
    return ChunkEncoder(path)


def parts_of(text: str, most: int = 1_000_000) -> Iterator[str]:
    """Runs of about `most` characters that end before a blank."""
    first = 0
    while len(text) - first > most:
        last = max(text.rfind(" ", first + 1, first + most), text.rfind("\n", first + 1, first + most))
        if last < 0:
            further = [k for k in (text.find(" ", first + most), text.find("\n", first + most)) if k >= 0]
            last = min(further, default=len(text))
        yield text[first:last]
        first = last
    yield text[first:]


def encoded(encoder: ChunkEncoder, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids of all texts in turn, taken up in runs of about a million characters; a longer text in several."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if len(text) > 1_000_000 and not encoder.whole:
            yield from encoder.encode(held)
            held, size = [], 0
            yield np.concatenate([encoder.encode([p])[0] for p in parts_of(text)])
            continue
        held.append(text)
        size += len(text)
        if size >= 1_000_000:
            yield from encoder.encode(held)
            held, size = [], 0
    yield from encoder.encode(held)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document as pieces of at most `capacity` tokens."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoded(encoder, batch["text"].tolist())):
                ids = np.append(ids, np.array([end_id], "<u4"))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pd.DataFrame({"id": batch["id"].iloc[rows].array, "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    return chosen.mapInPandas(run, schema)


Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal bins are filled together."""
    open_bins: dict[int, list[list]] = {}  # room left -> [items, number of such bins]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = min(left, capacity // length)
                n = left // each
                open_bins.setdefault(capacity - each * length, []).append([(length,) * each, n])
                left -= each * n
                continue
            items, n = open_bins[room].pop()
            each = min(room // length, left)
            fitted = min(n, left // each)
            if n > fitted:
                open_bins[room].append([items, n - fitted])
            elif not open_bins[room]:
                del open_bins[room]
            open_bins.setdefault(room - each * length, []).append([items + (length,) * each, fitted])
            left -= each * fitted
    return [(tuple(items), n) for bins in open_bins.values() for items, n in bins]


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """True if the items of a fit into those of b, so that b is as good (greedy test)."""
    rooms = sorted(b)
    for x in sorted(a, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - x)
    return True


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int, nodes: int) -> list[tuple[int, ...]]:
    """Undominated maximal fillings of a room, by rising waste; `lengths` rise and have counts.

    Larger pieces come first. One that fills the room exactly dominates all others, and a search
    over `nodes` nodes ends with the best found so far.
    """
    if room in counts and counts[room] > 0:
        return [(room,)]
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [nodes]

    def search(room: int, top: int, chosen: list[int], used: dict[int, int]) -> bool:
        at = min(bisect_right(lengths, room), top) - 1
        extended = False
        while at >= 0:
            x = lengths[at]
            if counts[x] > used.get(x, 0):
                extended = True
                budget[0] -= 1
                used[x] = used.get(x, 0) + 1
                done = search(room - x, at + 1, [*chosen, x], used)
                used[x] -= 1
                if done or budget[0] <= 0:
                    return done
            at -= 1
        if not extended:
            found.append((room, tuple(chosen)))
            return room == 0 and sum(w == 0 for w, _ in found) >= most
        return False

    search(room, len(lengths), [], {})
    kept: list[tuple[int, ...]] = []
    for _, f in sorted(found, key=lambda x: (x[0], len(x[1]))):
        if not any(dominated(f, g) for g in kept):
            kept.append(f)
            if len(kept) == most:
                break
    return kept


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound on bins: for each k, pieces longer than capacity - k stand without any of k or more; those above
    half stand alone, and only the room beside them takes what is between k and half (Martello and Toth)."""
    sizes = sorted(x for x, n in counts.items() if n)
    if not sizes:
        return 0
    x, n = np.array(sizes, np.int64), np.array([counts[s] for s in sizes], np.int64)
    number, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(x * n)))
    half, best = int(np.searchsorted(x, capacity // 2, "right")), -(-int(total[-1]) // capacity)
    for k in range(half + 1):
        least = x[k] if k < half else capacity // 2
        high = int(np.searchsorted(x, capacity - least, "right"))
        room = (number[high] - number[half]) * capacity - (total[high] - total[half])
        rest = total[half] - total[k] - room
        best = max(best, int(number[-1] - number[half]) + max(0, -(-int(rest) // capacity)))
    return best


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, width: int = 3, nodes: int = 400, steps: int = 20_000) -> tuple[list[Pattern], int]:
    """Patterns (lengths of a bin, number of such bins) that hold all pieces, and the lower bound on bins.

    `width` fillings are tried for a bin, each found within `nodes` nodes; after `steps` bins the
    incumbent stands.
    """
    total = sum(x * n for x, n in counts.items())
    lower = least_bins(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(n for _, n in best)
    left, used = steps, dict(counts)

    def undo(done: list) -> None:
        for items, n in done:
            for x in items:
                used[x] += n

    stack: list[tuple[Iterator[tuple[int, ...]], list]] = []  # an entry for each bin pattern on the path

    def options() -> Iterator[tuple[int, ...]]:
        lengths = sorted(x for x, n in used.items() if n)
        largest = lengths[-1]
        used[largest] -= 1
        got = fillings(lengths, used, capacity - largest, width, nodes) or [()]
        used[largest] += 1
        return iter([(largest, *f) for f in got])

    waste, bins = 0, 0
    if best_bins > lower and any(used.values()):
        stack.append((options(), []))
    while stack and left > 0 and best_bins > lower:
        choices, applied = stack[-1]
        if applied:  # take back what this level has tried
            undo(applied)
            bins -= applied[0][1]
            waste -= (capacity - sum(applied[0][0])) * applied[0][1]
            applied.clear()
        items = next(choices, None)
        if items is None:
            stack.pop()
            continue
        left -= 1
        need: dict[int, int] = {}
        for x in items:
            need[x] = need.get(x, 0) + 1
        n = min(used[x] // k for x, k in need.items())
        extra = (capacity - sum(items)) * n
        if waste + extra > (best_bins - 1) * capacity - total:
            n = min(n, max(0, ((best_bins - 1) * capacity - total - waste) // max(1, capacity - sum(items))))
            if n == 0:
                continue
            extra = (capacity - sum(items)) * n
        for x in items:
            used[x] -= n
        applied.append((items, n))
        bins, waste = bins + n, waste + extra
        if not any(used.values()):
            best, best_bins = [a[0] for _, a in stack if a], bins
        else:
            stack.append((options(), []))
    return best, lower


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (id, piece, length)."""
    every = cut(rows)
    # a full piece is a sequence of its own; numbers below 0 are theirs
    full = every.filter(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = every.filter(F.col("length") < capacity).withColumn("_part", F.pmod(F.xxhash64(F.col("id").cast("string"), "piece"), F.lit(PARTS)).cast("int"))
    histogram = cut(rows.groupBy("length", "_part").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in histogram.groupBy("length").agg(F.sum("n")).collect()}
    patterns, _ = bin_completion(counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {x: [] for x in counts}  # length -> (first rank, first sequence, offset)
    filled = dict.fromkeys(counts, 0)
    first = 0
    for items, n in patterns:
        at = 0
        for x in items:
            slots[x].append((filled[x], first, at))
            filled[x] += n
            at += x
        first += n
    tables = {x: np.array(v, np.int64).T for x, v in slots.items()}

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), np.int64)
        ranks, lengths = rank.to_numpy(), length.to_numpy()
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                start, sequence, at = tables[int(lengths[own[0]])]
                k = np.searchsorted(start, ranks[own], "right") - 1
                out[0, own], out[1, own] = sequence[k] + ranks[own] - start[k], at[k]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "_part").orderBy(F.xxhash64(F.col("id").cast("string"), "piece"), "id", "piece")
    placed = (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["length", "_part"])  # at most capacity * PARTS rows
        .withColumn("_place", place(F.col("length"), F.col("_before") + F.col("_rank")))
        .select("id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
    )
    return placed.union(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence and place."""
    return pack(pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
