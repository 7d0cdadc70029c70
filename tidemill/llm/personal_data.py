"""Personal data by a semi-Markov conditional random field over candidate segments.

Patterns with checks (mail addresses, IP addresses, card and phone numbers) give base spans. The
model works on segments of up to `MAX_TOKENS` tokens: features look at a whole span at once (digits,
dots, separators, checksum, address ranges, what stands before and after), labels of neighbouring
segments have transition weights, and a dynamic program over bounded entity lengths chooses
boundaries and kinds together. It is fitted by maximum likelihood (forward-backward over segments)
on a bounded sample: windows around numbers and at-signs of `fit_docs` documents, labelled by the
base patterns, and copies of them in which a base span is rewritten: into forms that the patterns
miss (a phone number without its country code, an address with "(at)") or into what is no personal
data (a wrong checksum, an address part over 255, dates, versions).

A text is scanned whole. The program runs over stretches of whole tokens that reach `MAX_TOKENS`
beyond each digit or at-sign: no segment further out can be an entity, and the last token of a
stretch is none, so that leaving the rest out changes nothing. A long stretch is scored in blocks of
tokens, and only its back pointers stay. Base spans stay; spans of the model are added where they
overlap no base span.

Defined results: null and empty texts have no spans; equal starts are ordered by kind; repeated rows
get equal results; with nothing to learn from, the model is fitted on invented values; an empty
table gives an empty result; extra columns pass through, and one that is named like a result stays
under its name with `_input` behind it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import aside

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: Tokens that are scored at once, and tokens of a window of the sample.
BLOCK, WINDOW_TOKENS = 4096, 48

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\W_]+|\s|[^\w\s]|_")
_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def is_card(text: str) -> bool:
    digits = _NO_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, in time linear in the text.

    All that can match before an at-sign is the run of local characters in front of it, behind the
    match before; what follows decides for all starts in that run at once.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start, step = at, 64
            while start > free:
                part = text[max(free, start - step) : start]
                left = part.rstrip(_LOCAL)
                start -= len(part) - len(left)
                if left:
                    break
                step *= 2
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def tokens_before(text: str, at: int, count: int) -> int:
    """Where the token starts that is `count` tokens before the one that holds or follows `at`."""

    def word_start(k: int) -> int:
        while k > 0 and text[k - 1].isalnum():
            k -= 1
        return k

    at = word_start(at) if text[at].isalnum() else at
    for _ in range(count):
        if at == 0:
            break
        at = word_start(at - 1) if text[at - 1].isalnum() else at - 1
    return at


def tokens_after(text: str, at: int, count: int) -> int:
    """Where the token ends that is `count` tokens after the one at `at`; `at` stands inside or at the start of a token."""
    for _ in range(count + 1):
        m = _TOKEN.match(text, at)
        if m is None:
            break
        at = m.end()
    return at


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of whole tokens around digits and at-signs."""
    start = end = -1
    at = 0
    while (m := _ANCHOR.search(text, at)) is not None:
        before = tokens_before(text, m.start(), MAX_TOKENS) if m.start() > end else end
        if before > end:
            if end >= 0:
                yield start, end
            start = before
        end = tokens_after(text, m.end() - 1, MAX_TOKENS)
        at = _TOKEN.match(text, m.end() - 1).end()  # further signs in this token change nothing
    if end >= 0:
        yield start, end


NAMES = (
    "one", "digit free", "short digits", "few digits", "phone digits", "13 digits", "card digits", "many digits",
    "at", "dot 1", "dot 2", "dot 3", "dots", "plus first", "bracket", "letters", "blank", "hyphen", "luhn", "ip",
    "joined before", "joined after", "domain end", "letters at start", "only digits", "plus before", "spelled at", "odd sign",
)


@dataclass
class Segments:
    """All segments of a stretch: features (token, length - 1, feature), which may be entities, token places."""

    features: np.ndarray
    entity: np.ndarray
    places: list[tuple[int, int]]


def segments(text: str, shift: int = 0) -> Segments:
    """Segment [t, k] ends with token t and has k + 1 tokens."""
    found = list(_TOKEN.finditer(text))
    tokens = [m[0] for m in found]
    n = len(tokens)
    ends = np.arange(n)[:, None]
    begins = ends - np.arange(MAX_TOKENS)[None, :]
    valid = begins >= 0
    begins = np.maximum(begins, 0)

    def within(values: list) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[ends + 1] - sums[begins]

    ascii_digits = [sum("0" <= c <= "9" for c in t) for t in tokens]
    digits, dots = within(ascii_digits), within([t == "." for t in tokens])
    at = within([t == "@" for t in tokens])
    spelled = within([t == "at" and 0 < k < n - 1 and tokens[k - 1] in "([" and tokens[k + 1] in ")]" for k, t in enumerate(tokens)])
    letters = within([len(t) - d if t[0].isalnum() else 0 for t, d in zip(tokens, ascii_digits, strict=True)])
    plus = np.array([t == "+" for t in tokens], bool)
    begin_ok = np.array([t[0].isalnum() or t in "+(" for t in tokens], bool)
    solid = np.array([t[0].isalnum() or t in "_@" for t in tokens], bool)
    end_ok = np.array([t[0].isalnum() for t in tokens], bool)
    alpha = np.array([t.isalpha() for t in tokens], bool)
    lines = within([t in "\n\r" for t in tokens])
    before = np.concatenate(([False], solid))[begins]
    after = np.concatenate((solid, [False]))[ends + 1] & np.ones_like(valid)
    entity = valid & begin_ok[begins] & end_ok[ends] & (lines == 0) & ((digits >= 4) | (at == 1) | (spelled == 1))
    check = np.zeros((2, n, MAX_TOKENS), bool)
    hyphens, blanks = within([t == "-" for t in tokens]), within([t.isspace() for t in tokens])
    for k, test, mask in ((0, is_card, (digits >= 14) & (digits <= 19) & (letters == 0)), (1, is_ip, (dots == 3) & (digits >= 4) & (letters == 0))):
        for t, w in zip(*np.nonzero(mask & entity), strict=True):
            check[k, t, w] = test(text[found[t - w].start() : found[t].end()])
    odd = within([not (t[0].isalnum() or t.isspace() or t in ".@+-()_%[]") for t in tokens])
    one = np.ones_like(digits)
    columns = (
        one, digits == 0, (digits > 0) & (digits < 4), (digits >= 4) & (digits < 10), (digits >= 10) & (digits < 13), digits == 13, (digits >= 14) & (digits < 20), digits >= 20,
        at == 1, dots == 1, dots == 2, dots == 3, dots > 3, plus[begins], within([t == "(" for t in tokens]) > 0, letters > 0, blanks > 0, hyphens > 0, check[0], check[1],
        before, after, alpha[ends] & (np.concatenate(([False], np.array([t == "." for t in tokens], bool)))[ends]) & one.astype(bool), alpha[begins],
        (letters == 0) & (digits > 0), np.concatenate(([False], plus))[begins], spelled == 1, odd > 0,
    )
    return Segments(np.stack([np.asarray(c, np.float32) for c in columns], axis=-1), entity, [(shift + m.start(), shift + m.end()) for m in found])


@dataclass
class Field:
    """Weights of features by label (0 is no entity, then KINDS) and of transitions."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: np.ndarray, entity: np.ndarray) -> np.ndarray:
        out = features @ self.weights
        out[..., 1:][~entity] = -np.inf
        out[..., 1:, 0] = -np.inf  # what is no entity is a segment of one token
        return out

    def decode(self, text: str, start: int = 0, end: int | None = None) -> list[Span]:
        """The best segmentation of a stretch of whole tokens."""
        end = len(text) if end is None else end
        begins = np.fromiter((m.start() for m in _TOKEN.finditer(text, start, end)), np.int64)
        n, labels = len(begins), len(KINDS) + 1
        if not n:
            return []
        stops = np.append(begins[1:], end)
        back, came = np.zeros((n, labels), np.int8), np.zeros((n + 1, labels), np.int8)
        entered = np.full((MAX_TOKENS, labels), -np.inf)  # best score of what ends before a token, by the label that follows; the last ones
        entered[-1] = self.moves[0]
        found = False
        for x in range(0, n, BLOCK):
            y, low = min(n, x + BLOCK), max(0, x - MAX_TOKENS - 1)
            s = segments(text[begins[low] : stops[min(n - 1, y)]])
            own = slice(x - low, y - low)
            found |= bool(s.entity[own].any())
            scores = self.scores(s.features[own].astype(np.float64), s.entity[own])
            entered = np.concatenate((entered, np.empty((y - x, labels))))
            for t in range(x, y):
                width, k = min(t + 1, MAX_TOKENS), t - x + MAX_TOKENS - 1
                options = entered[k - np.arange(width)] + scores[t - x, :width]
                back[t] = options.argmax(axis=0)
                best = options.max(axis=0)
                onward = best[:, None] + self.moves
                came[t + 1], entered[k + 1] = onward.argmax(axis=0), onward.max(axis=0)
            entered = entered[-MAX_TOKENS:]
        out, t, label = [], n - 1, int(best.argmax())
        while found and t >= 0:
            width = int(back[t, label])
            if label:
                out.append((int(begins[t - width]), label - 1, int(stops[t])))
            label, t = int(came[t - width, label]), t - width - 1
        return out[::-1]

    def expectations(self, x: np.ndarray, entity: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log of the sum over all segmentations of each window, expected features by label, expected moves).

        Windows of unlike length stand in arrays of one length; `last` is their number of tokens.
        """
        n, tokens = x.shape[:2]
        labels, rows = len(KINDS) + 1, np.arange(n)
        scores = self.scores(x.astype(np.float64), entity)
        entered = np.full((n, tokens + 1, labels), -np.inf)
        entered[:, 0] = self.moves[0]
        ended = np.full((n, tokens, labels), -np.inf)
        for t in range(tokens):
            width = min(t + 1, MAX_TOKENS)
            ended[:, t] = _total(entered[:, t - np.arange(width)] + scores[:, t, :width], 1)
            entered[:, t + 1] = _total(ended[:, t, :, None] + self.moves, 1)
        whole = _total(ended[rows, last - 1], 1)
        # rest[t]: all that follows token t, by the label that ended there
        rest = np.full((n, tokens + MAX_TOKENS, labels), -np.inf)
        onward = np.full((n, tokens + 1, labels), -np.inf)  # all that starts at t, by its first label
        for t in range(tokens - 1, -1, -1):
            rest[:, t] = np.where((last - 1 == t)[:, None], 0.0, _total(self.moves + onward[:, t + 1, None, :], 2) if t + 1 < tokens else -np.inf)
            width = min(MAX_TOKENS, tokens - t)
            ahead = t + np.arange(width)
            onward[:, t] = _total(scores[:, ahead, np.arange(width)] + rest[:, ahead], 1)
        expected, moved = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for t in range(tokens):
            width = min(t + 1, MAX_TOKENS)
            p = np.exp(entered[:, t - np.arange(width)] + scores[:, t, :width] + rest[:, t, None] - whole[:, None, None])
            p[last <= t] = 0
            expected += np.einsum("nwf,nwl->fl", x[:, t, :width], p, optimize=True)
            if t + 1 < tokens:
                m = np.exp(ended[:, t, :, None] + self.moves + onward[:, t + 1, None, :] - whole[:, None, None])
                m[last <= t + 1] = 0
                moved += m.sum(axis=0)
        moved[0] += np.exp(entered[:, 0] + onward[:, 0] - whole[:, None]).sum(axis=0)
        return whole, expected, moved


def _total(x: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return np.squeeze(np.log(np.exp(x - top).sum(axis=axis, keepdims=True) + 1e-300) + top, axis=axis)


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Maximum likelihood by forward-backward over all segments of all windows at once."""
    labels, features = len(KINDS) + 1, len(NAMES)
    made = [(s, spans) for s, spans in ((segments(text), spans) for text, spans in examples) if s.places]
    n, tokens = len(made), max(len(s.places) for s, _ in made)
    x, entity = np.zeros((n, tokens, MAX_TOKENS, features), np.float32), np.zeros((n, tokens, MAX_TOKENS), bool)
    last = np.array([len(s.places) for s, _ in made])
    truth, moves_seen = np.zeros((features, labels)), np.zeros((labels, labels))
    for k, (s, spans) in enumerate(made):
        x[k, : last[k]], entity[k, : last[k]] = s.features, s.entity
        ends, t, before = {e: (b, kind) for b, kind, e in spans}, last[k] - 1, []
        while t >= 0:
            width, label = 0, 0
            if s.places[t][1] in ends:
                b, kind = ends[s.places[t][1]]
                w = next((w for w in range(min(t + 1, MAX_TOKENS)) if s.places[t - w][0] == b), None)
                if w is not None and s.entity[t, w]:
                    width, label = w, kind + 1
            truth[:, label] += s.features[t, width]
            before.append(label)
            t -= width + 1
        for a, b in zip([0, *before[::-1]], before[::-1], strict=False):
            moves_seen[a, b] += 1
    field = Field(np.zeros((features, labels)), np.zeros((labels, labels)))
    state = [np.zeros_like(v) for v in (field.weights, field.weights, field.moves, field.moves)]
    for step in range(1, rounds + 1):
        _, expected, moved = field.expectations(x, entity, last)
        for k, (value, seen, want) in enumerate(((field.weights, truth, expected), (field.moves, moves_seen, moved))):
            g = (want - seen) / n + decay * value
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            value -= rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return field


def rewritten(text: str, span: Span, k: int) -> tuple[str, list[Span]]:
    """A window with one base span rewritten, and the spans it has then: a missed form or no personal data."""
    start, kind, end = span
    value, keep = text[start:end], True
    if kind == 0:
        value = value.replace("@", (" (at) ", "[at]", "(at)")[k % 3], 1)
    elif kind == 1:
        value, keep = (f"{256 + k % 700}" + value[value.index(".") :], False) if k % 2 else (".".join(value.split(".")[: 2 + k % 4 // 2]), False)
    elif kind == 2:
        digits, keep = _NO_DIGIT.sub("", value), False
        value = digits[:-1] + str((int(digits[-1]) + 1 + k % 8) % 10) if k % 3 else f"20{10 + k % 20}-0{1 + k % 9}-{10 + k % 18}"
    else:
        local = value.split("(", 1)
        value = ("(" + local[1]) if len(local) == 2 and k % 2 else _NO_DIGIT.sub("-", value.lstrip("+")).strip("-")
    return text[:start] + value + text[end:], [(start, kind, start + len(value))] if keep else []


def invented() -> list[str]:
    """Windows with one value each, for corpora that show none."""
    return [
        s for k in range(12) for s in (
            f"and write to some.one{k}@mail{k}.example.com about it", f"from 10.{k}.{20 + k}.{200 + k} on that", f"call +1 ({201 + k}) 555-01{10 + k} for them",
            "paid with " + next(f"41111111111{k:02d}{j:03d}" for j in range(1000) if luhn(f"41111111111{k:02d}{j:03d}")) + " by then",
        )
    ]


def sample_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 300, fit_windows: int = 240, seed: str = "") -> list[str]:
    """Windows around digits and at-signs: those with the least hashes, of the documents with the least hashes of their id."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    chosen = rows.select(F.xxhash64("id", F.lit(seed)).alias("h"), "id").distinct().orderBy("h", "id").limit(fit_docs)
    windows = F.regexp_extract_all("text", F.lit(r"(?s)(.{0,60}[0-9@][^ ]{0,60}.{0,60})"), 1)
    # at most fit_docs ids: a bounded broadcast; of rows with one id the least text is taken
    found = rows.join(F.broadcast(chosen), "id").groupBy("h").agg(F.min("text").alias("text"))
    taken = found.select(F.explode(windows).alias("w")).distinct().orderBy(F.xxhash64("w", F.lit(seed)), "w").limit(fit_windows).collect()
    return [r["w"][: tokens_after(r["w"], 0, WINDOW_TOKENS - 1)] for r in taken]


def examples_of(windows: list[str]) -> list[tuple[str, list[Span]]]:
    """Windows with their base spans, and after each window with one span the same with the span rewritten."""
    examples: list[tuple[str, list[Span]]] = []
    for text in windows:
        spans = base_spans(text)
        examples.append((text, spans))
        if len(spans) == 1:
            examples.append(rewritten(text, spans[0], len(examples)))
    return examples


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 300, fit_windows: int = 240) -> Field:
    """Fit on at most `fit_windows` windows of a bounded sample of `fit_docs` documents, and on invented ones."""
    return fit(examples_of([*sample_windows(docs, id_col, text_col, fit_docs, fit_windows), *invented()]))


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that the model adds."""
    base, added = base_spans(text), []
    for start, end in stretches(text):
        added += [x for x in field.decode(text, start, end) if not any(s < x[2] and x[0] < f for s, _, f in base)]
    return base, sorted(base + added)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (of the base spans), base (joined base spans) and spans (all)."""

    @F.pandas_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")
    def of(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            base, spans = find(t, field) if t else ([], [])
            rows.append((*[sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))], joined(base), joined(spans)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    rest = aside(docs, ("n_email", "n_ip", "n_card", "n_phone", "base", "spans"))
    return docs.withColumn("_tm_found", of(F.col(text_col))).select(*rest, "_tm_found.*")


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal_data(docs, train(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )
