"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text is kept as a suffix automaton. A text is parsed
against it into longest matches, left to right: each phrase is the longest piece that occurs in the
sample, or one character that does not. Related text needs few phrases, so with c phrases in n
characters of text against a sample of m characters, c * log2(m) / n estimates the cross entropy.
The language with the least such value wins, ties by name.

Letters are compared in lower case, and everything between letters counts as one blank. Texts are
parsed whole, each in the task that reads it; no shuffle. The pieces of all texts of a batch are
walked side by side with numpy: each piece starts a phrase of its own first, then the walk of the
piece before goes on into it until both start a phrase at one place, from where they agree. The
sample is bounded by `sample_docs` documents for each language and `sample_chars` characters for
each document, taken at a place that the hash of its id picks.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything
if no labelled text can be learned from; with one language the score is 1; rows with null ids count
as not held out; repeated rows get equal results; extra columns pass through, and one that is named
like a result stays under its name with `_input` behind it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import aside, cut, held_out, small

SAMPLE_DOCS, SAMPLE_CHARS = 64, 600
#: Characters of a piece, characters that are parsed side by side, and rounds after which a text is parsed alone.
PIECE, TOGETHER, ROUNDS = 256, 1 << 22, 2
#: Bits of a state in an entry of the table of moves.
STATE_BITS = 20


@cache
def kinds() -> np.ndarray:
    """For every code point: 2 for a letter, 1 for a mark, 0 for what counts as a blank."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str | None) -> np.ndarray:
    """Code points of lower-case letters with single blanks between words and around; empty without letters."""
    points = code_points(text.lower()) if text else np.zeros(0, np.uint32)
    kind = kinds()[points]
    if not (kind == 2).any():
        return np.zeros(0, np.uint32)
    inside = kind > 0
    points = np.where(inside, points, 32)
    keep = inside | np.append(inside[1:], False)  # of what stands between words the last character stays
    kept = points[keep]
    return np.concatenate(([32], kept, [32]) if kept[0] != 32 else (kept, [32])).astype(np.uint32)


class Automaton:
    """Suffix automaton; transitions lie in one dict under (state << width) + symbol, each character of the sample is a symbol from 1 on.

    The same transitions lie in a table with open addressing, entries key << STATE_BITS | state.
    """

    def __init__(self, points: np.ndarray) -> None:
        if len(points) >= 1 << (STATE_BITS - 1):
            raise ValueError("a sample holds at most 524287 characters")
        self.size = max(2, len(points))
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        self.width = int(len(self.alphabet)).bit_length()
        self.symbol_of = np.zeros(int(self.alphabet[-1]) + 2 if len(points) else 1, np.int32)
        self.symbol_of[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in (symbols + 1).tolist():
            state = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = state
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
        self.next = {(s << self.width) + c: t for s, m in enumerate(moves) for c, t in m.items()}
        self.root = np.zeros(len(self.alphabet) + 1, np.int64)
        for c, t in moves[0].items():
            self.root[c] = t
        self._lay_out()

    def _lay_out(self) -> None:
        keys, states = np.fromiter(self.next.keys(), np.int64, len(self.next)), np.fromiter(self.next.values(), np.int64, len(self.next))
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = keys[free] << STATE_BITS | states[free]  # of several for one slot the last stays
            left = left[(self.table[slot[left]] >> STATE_BITS) != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase starts with the symbol) for many walks at once."""
        keys = (state << self.width) + symbol
        slot = self._slots(keys)
        entry = self.table[slot]
        other = np.flatnonzero((entry >= 0) & (entry >> STATE_BITS != keys))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            entry[other] = self.table[slot[other]]
            other = other[(entry[other] >= 0) & (entry[other] >> STATE_BITS != keys[other])]
        none = entry < 0
        return np.where(none, self.root[symbol], entry & ((1 << STATE_BITS) - 1)), none | (state == 0)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of characters, 0 for those that are not in the sample."""
        return self.symbol_of[np.minimum(points, len(self.symbol_of) - 1)]

    def phrases(self, symbols: np.ndarray) -> int:
        """Number of longest matches that one text falls into; unknown characters are phrases of their own."""
        follow, count, state, width = self.next.get, 0, 0, self.width
        for c in symbols.tolist():
            to = follow((state << width) + c)
            if to is None:
                count += state != 0
                to = follow(c)  # the next phrase starts with this character
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state != 0)

    def phrases_of_all(self, layout: Layout) -> np.ndarray:
        """The number of phrases of each text of a layout."""
        symbols, size = self.symbols(layout.points), layout.size

        def walk(own: np.ndarray, state: np.ndarray, until: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Walk pieces, longest first, from given states: (end states, starts of phrases, place where a walk met `until` or -1)."""
            rows = symbols if until is None else symbols[:, own]
            starts, met, ends = np.zeros(rows.shape, bool), np.full(len(own), -1), np.zeros(len(own), np.int64)
            live, at = np.searchsorted(-size[own], -np.arange(PIECE), "left"), np.arange(len(own))
            for t in range(PIECE):
                if until is None:
                    ends[live[t] : len(state)] = state[live[t] :]
                    state = state[: live[t]]
                    if not len(state):
                        break
                    state, starts[t, : live[t]] = self.step(state, rows[t, : live[t]])
                    continue
                state, new = self.step(state, rows[t, at])
                starts[t, at] = new
                meets = new & until[t, own[at]]
                leaves = meets | (size[own[at]] == t + 1)
                if leaves.any():
                    met[at[meets]] = t
                    ends[at[leaves]] = state[leaves]
                    at, state = at[~leaves], state[~leaves]
                    if not len(at):
                        break
            if until is None:
                ends[: len(state)] = state
            return ends, starts, met

        every = np.arange(len(size))
        anew, alone, _ = walk(every, np.zeros(len(size), np.int64))
        up_to = np.cumsum(alone, axis=0, dtype=np.int16)
        ends, starts, redo = anew.copy(), up_to[-1].astype(np.int64), every[layout.before >= 0]
        for _ in range(ROUNDS):
            if not len(redo):
                break
            ended, found, met = walk(redo, ends[layout.before[redo]], alone)
            # where a walk has met the piece's own, the piece's own starts count from there on
            starts[redo] = found.sum(axis=0) + up_to[-1, redo] - up_to[met, redo]
            ended = np.where(met >= 0, anew[redo], ended)
            changed = redo[ended != ends[redo]]
            ends[redo] = ended
            redo = np.sort(layout.after[changed])
            redo = redo[redo >= 0]
        counts = np.bincount(layout.text, starts, layout.texts).astype(np.int64)
        for t in np.unique(layout.text[redo]):
            own = np.flatnonzero(layout.text == t)
            own = own[np.argsort(layout.number[own])]
            counts[t] = self.phrases(np.concatenate([symbols[: size[p], p] for p in own]))
        return counts


class Layout:
    """Texts cut into pieces that stand side by side, longest first: points by place and piece, and how pieces follow each other."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // PIECE)
        self.texts = len(texts)
        text = np.repeat(np.arange(len(texts)), pieces)
        opens = np.cumsum(pieces) - pieces
        number = np.arange(len(text)) - opens[text]
        size = np.minimum(PIECE, sizes[text] - number * PIECE)
        flat = np.zeros(len(text) * PIECE, np.uint32)
        begins = np.cumsum(sizes) - sizes
        flat[np.arange(sizes.sum()) + np.repeat(opens * PIECE - begins, sizes)] = np.concatenate(texts)
        order = np.argsort(-size, kind="stable")
        self.points = np.ascontiguousarray(flat.reshape(-1, PIECE)[order].T)
        self.size, self.text, self.number = size[order], text[order], number[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.before = np.where(number > 0, np.roll(place, 1), -1)[order]
        self.after = np.where(number < pieces[text] - 1, np.roll(place, -1), -1)[order]


@lru_cache(maxsize=512)
def automaton(sample: bytes) -> Automaton:
    """One automaton per sample and worker process."""
    return Automaton(np.frombuffer(sample, np.uint32))


class Identifier:
    """Samples by language; picks the language that needs the fewest phrases."""

    def __init__(self, samples: dict[str, np.ndarray]) -> None:
        self.samples = {k: v.astype(np.uint32).tobytes() for k, v in sorted(samples.items()) if len(v)}

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, held, owner, size = [("und", 0.0)] * len(texts), [], [], 0
        if not self.samples:
            return out

        def decide() -> None:
            layout, sizes = Layout(held), np.array([len(h) for h in held])
            found = np.empty((len(self.samples), len(held)))
            for k, sample in enumerate(self.samples.values()):
                a = automaton(sample)
                found[k] = a.phrases_of_all(layout) * np.log2(a.size) / sizes
            order, names = np.argsort(found, axis=0, kind="stable"), list(self.samples)
            for i, t in enumerate(owner):
                best = found[order[0, i], i]
                out[t] = names[order[0, i]], float(1 - best / found[order[1, i], i]) if len(names) > 1 else 1.0

        for t, text in enumerate(texts):
            bare = letters(text)
            if len(bare):
                held.append(bare)
                owner.append(t)
                size += len(bare)
            if held and (size >= TOGETHER or t == len(texts) - 1):
                decide()
                held, owner, size = [], [], 0
        if held:
            decide()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Identifier:
    """Samples from labelled rows outside the held-out fold; the driver gets the bounded sample only.

    The sample of a language is its `sample_docs` distinct (id, text) of least hash. Tasks keep that many
    hashes for each language; the largest of the least ones is the bound of a second pass, which
    takes one piece of text for each hash. No language is gathered whole anywhere.
    """
    text, own = F.col(text_col), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(own, text)
    place = 1 + F.pmod(F.xxhash64(own, text, F.lit("place")), F.greatest(F.lit(1), F.length(text) - sample_chars + 1))
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text) > 0) & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), hashed.alias("h"), text.alias("text"), place.cast("int").alias("place"))

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang")["h"]:
                found[lang] = np.unique(np.concatenate((found.get(lang, np.zeros(0, np.int64)), part.to_numpy(np.int64))))[:sample_docs]
        for lang, h in found.items():
            yield pd.DataFrame({"lang": lang, "h": h})

    by_hash = Window.partitionBy("lang").orderBy("h")
    ranked = rows.select("lang", "h").mapInPandas(least, "lang string, h bigint").distinct().withColumn("rank", F.row_number().over(by_hash))
    bounds = cut(ranked.filter(F.col("rank") <= sample_docs).groupBy("lang").agg(F.max("h").alias("bound")))
    piece = F.substring("text", F.col("place"), F.lit(sample_chars))
    chosen = rows.join(small(bounds), "lang").filter("h <= bound").groupBy("lang", "h").agg(F.min(piece).alias("text")).collect()
    samples: dict[str, list[np.ndarray]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(letters(r["text"]))
    return Identifier({k: np.concatenate(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict_all(text.tolist()), columns=["lang_pred", "score"])

    rest = aside(docs, ("lang_pred", "score"))
    return docs.withColumn("_tm_lang", of(F.col(text_col))).select(*rest, "_tm_lang.lang_pred", "_tm_lang.score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
