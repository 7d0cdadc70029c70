"""The text operators against brute force, and their defined results for odd inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemill.llm import language_id, line_dedup, minhash, mixing, packing, personal_data, quality_model, quality_rules, suffix_dedup, topk
from tidemill.llm.common import with_row_key
from tidemill.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, id string, score string, n string"
LONG = " ".join(f"word{k % 997}" for k in range(20000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows, clashing names."""
    texts = [None, "", " \n\t ", "a", "same words here again\nsame words here again", LONG, LONG, "x" * 5000, "é ü   ß \x00 \x1c", "one two three\n\none two three\n"]
    rows = [(k, t, None, None, None, "r", "k", "i", "s", "n") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "text of no id", "en", "s", 3, None, None, None, None, None), (None, None, None, "s", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet").cache()


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(50)] + [(k, k + 1) for k in range(100, 120)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()} == {x: top(x) for x in parent}


# 1 line dedup


def test_line_dedup_rules(spark):
    base = "the quick brown fox jumps over the lazy dog"
    text = "\n".join([base, base.upper(), base.replace("quick", "slow"), base + " today", base.replace("fox", "cat").replace("dog", "cow"), "", "short line", "short lane", "short line"])
    df = spark.createDataFrame([(1, text), (2, base.replace("lazy", "idle") + "\nnew")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.without_lines(df).collect()}
    assert got[1].text.split("\n") == [base, base.replace("fox", "cat").replace("dog", "cow"), "", "short line", "short lane"]
    assert (got[1]._tm_exact, got[1]._tm_near) == (2, 2)
    assert got[2].text == "new"


def test_line_dedup_odd(odd, none):
    got = line_dedup.without_lines(odd)
    assert got.count() == odd.count() and got.columns[: len(odd.columns)] == odd.columns
    assert got.filter("doc_id = 0 and text is not null").isEmpty()
    assert sum(r.text == LONG for r in got.filter("doc_id in (5, 6)").collect()) == 1
    assert line_dedup.without_lines(none).count() == 0


def test_within_one():
    a = np.array
    assert line_dedup.within_one(a([1, 2, 3]), a([1, 9, 3])) and line_dedup.within_one(a([1, 2, 3]), a([1, 3])) and line_dedup.within_one(a([1, 2]), a([1, 2, 3]))
    assert not line_dedup.within_one(a([1, 2, 3]), a([1, 9, 9])) and not line_dedup.within_one(a([1, 2, 3, 4]), a([2, 1]))


# 2 language


def longest_matches(text, sample):
    count = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def phrases(sample, texts):
    a = language_id.Automaton(language_id.code_points(sample))
    points = [language_id.code_points(t) for t in texts]
    many = a.phrases_of_all(language_id.Layout(points)).tolist()
    assert many == [a.phrases(a.symbols(x)) for x in points]
    return many


def test_letters():
    shown = lambda t: "".join(map(chr, language_id.letters(t)))
    plain = lambda t: f" {' '.join(regex.findall(r'[\p{L}\p{M}]+', t.lower()))} " if regex.search(r"\p{L}", t) else ""
    for t in ("", "  ", "1234", "Ab", " Ab!c ", "--É, ü2ß--", "a\nb\n", "x", "\u0301", "e\u0301 1"):
        assert shown(t) == plain(t), t
    assert shown(None) == ""


def test_parsing_equals_search():
    random.seed(5)
    for _ in range(30):
        sample = "".join(random.choice("abc ") for _ in range(random.randint(1, 40)))
        text = "".join(random.choice("abcd ") for _ in range(random.randint(1, 60)))
        assert phrases(sample, [text]) == [longest_matches(text, sample)]


def test_parsing_many_texts_in_pieces(monkeypatch):
    """Short pieces, so that walks must go on over many of them, up to texts that are parsed alone."""
    random.seed(8)
    monkeypatch.setattr(language_id, "PIECE", 7)
    for k in range(40):
        sample = "".join(random.choice("ab " if k % 2 else "abcdefgh") for _ in range(random.randint(1, 300)))
        texts = ["".join(random.choice("abcz ") for _ in range(random.randint(1, 90))) for _ in range(6)]
        texts += [sample, sample[5:200] * 2 or "a", "aab" * 40, "a"]
        assert phrases(sample, texts) == [longest_matches(t, sample) for t in texts]


def test_languages_of_many_letters():
    """Two languages of 1000 shared letters with samples of unlike size: the words decide, not the size of the sample."""
    random.seed(6)
    alphabet = [chr(0x4E00 + 7 * k) for k in range(1000)]
    words = {lang: ["".join(random.choices(alphabet, k=3)) for _ in range(600)] for lang in ("large", "small")}
    say = lambda lang, n: f" {' '.join(random.choices(words[lang], k=n))} "
    samples = {"large": say("large", 8000), "small": say("small", 1500)}
    model = language_id.Identifier({k: language_id.letters(v) for k, v in samples.items()})
    assert [model.predict(say(lang, 40))[0] for lang in ("large", "small") for _ in range(10)] == ["large"] * 10 + ["small"] * 10
    sample = samples["small"]
    for text in (say("small", 60), say("large", 60), sample[100:300] + "Ω" + sample[50:90]):
        assert phrases(sample, [text]) == [longest_matches(text, sample)]
    for n in (254, 255, 256, 257):
        sample = "".join(random.choices([chr(0xC0 + k) for k in range(n)], k=4000)) + "".join(chr(0xC0 + k) for k in range(n))
        text = sample[:40] + "?" + sample[1000:1100] + "".join(random.choices(sample, k=200))
        assert phrases(sample, [text]) == [longest_matches(text, sample)]


def test_language_held_out(spark, docs):
    got = language_id.identify(docs, language_id.learn(docs)).filter("lang is not null and length(text) > 100")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95


def test_language_equals_plain_prediction(docs):
    """Each text alone, by searching the sample text for longest matches."""
    model = language_id.learn(docs)
    samples = {k: "".join(map(chr, np.frombuffer(v, np.uint32))) for k, v in model.samples.items()}
    for r in language_id.identify(docs, model).filter("length(text) < 600").orderBy("doc_id").limit(25).collect():
        bare = "".join(map(chr, language_id.letters(r.text)))
        costs = sorted((longest_matches(bare, s) * np.log2(len(s)) / len(bare), k) for k, s in samples.items()) if bare else [(0, "und")] * 2
        assert r.lang_pred == costs[0][1] and abs(r.score - (1 - costs[0][0] / costs[1][0] if bare else 0)) < 1e-12


def test_language_sample_of_repeated_and_null_ids(spark):
    """Rows are told apart by id and text: few ids or none still give a sample, and copies fill it only once."""
    rng = random.Random(1)
    word = {"de": ["und", "der", "nicht", "schon", "straße"], "en": ["and", "the", "not", "already", "street"]}
    rows = [(k % 3 if own else None, " ".join(rng.choice(word[lang]) for _ in range(30)), lang) for own in (True, False) for lang in word for k in range(600)]
    one = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 4 != 2)  # an id that may be learned from
    rows += [(None, "same text of copies", "fr")] * 500 + [(None, "un autre texte rare", "fr")]
    for part in (rows, [r for r in rows if r[0] is None], [(one, *r[1:]) for r in rows if r[0] is not None]):
        model = language_id.learn(spark.createDataFrame(part, "doc_id long, text string, lang string").repartition(5), sample_docs=64)
        sizes = {k: len(v) // 4 for k, v in model.samples.items()}
        assert {"de", "en"} <= set(sizes) and all(64 * 60 < sizes[k] < 64 * 200 for k in ("de", "en"))
        assert model.predict("und der nicht")[0] == "de" and model.predict("the street and not")[0] == "en"
        if "fr" in sizes:
            assert 30 < sizes["fr"] < 60


def test_language_odd(odd, none):
    got = language_id.identify(odd, language_id.learn(odd))
    assert got.columns == [*odd.columns[:-2], "score_input", "n", "lang_pred", "score"] and {r.score_input for r in got.collect()} == {"s", None}
    assert {r.lang_pred for r in got.filter("doc_id in (0, 1, 2)").collect()} == {"und"} and got.count() == odd.count()
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.learn(none)).collect()} == {"und"}


# 3 suffix dedup


def repeats(rows, width):
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(hash(r[i : i + width]) for _, r in raws for i in range(len(r) - width + 1))
    out = []
    for k, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - width + 1):
            if seen[hash(r[p : p + width])] > 1:
                gone[p : p + width] = b"\1" * width
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((k, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_column_sort():
    random.seed(1)
    for _ in range(60):
        width = random.choice([3, 4, 5, 8])
        strings = [bytes(random.choice(b"ab\x00c") for _ in range(random.randint(width, 25))) for _ in range(random.randint(1, 9))] + [b"abcabcabcabc"] * random.randint(0, 2)
        seen = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
        want = sorted((k, i) for k, s in enumerate(strings) for i in range(len(s) - width + 1) if seen[s[i : i + width]] > 1)
        assert sorted(zip(*map(list, suffix_dedup.column_sort(strings, width)), strict=True)) == want


def test_column_sort_in_wide_symbols():
    """Strings of several windows take a round for each 50 bytes; with too many symbols for 16 bits they take narrower ones."""
    random.seed(2)
    parts = [bytes(random.choice(b"abcd") for _ in range(70)) for _ in range(6)]
    strings = [b"".join(random.choice(parts) for _ in range(5))[random.randint(0, 9) :] for _ in range(30)]
    table, *_, wide = suffix_dedup.symbol_table(strings, 100)
    assert wide == 50 and len(table) <= 1 + 350 // 50
    many = [bytes(random.choices(range(200), k=60)) for _ in range(7000)]
    many += [random.randbytes(5) + m[:53] for m in many[::99]]
    assert suffix_dedup.symbol_table(many, 50)[-1] == 2
    for group, width in ((strings, 100), (many, 50)):
        seen = Counter(s[i : i + width] for s in group for i in range(len(s) - width + 1))
        want = sorted((k, i) for k, s in enumerate(group) for i in range(len(s) - width + 1) if seen[s[i : i + width]] > 1)
        assert want and sorted(zip(*map(list, suffix_dedup.column_sort(group, width)), strict=True)) == want


def test_units_cover_whole_windows_of_each_text():
    random.seed(3)
    texts = [bytes(random.choice(b"ab ") for _ in range(n)) for n in (20, 21, 57, 200, 20)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    _, seg, first, last = suffix_dedup.units(data, ends, 20, 6)
    starts = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    assert starts == [i for e, t in zip(ends, texts, strict=True) for i in range(e - len(t), e - 20 + 1)]
    assert len(set(seg)) == len({data[a : b + 20].tobytes() for a, b in zip(first, last, strict=True)})


@pytest.mark.parametrize("width,gram,most", [(400, 64, 4096), (100, 24, 2)])
def test_suffix_dedup(docs, width, gram, most):
    keyed = with_row_key(docs.select("doc_id", "text"))
    got = sorted([(r.row, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.without_repeats(keyed, "text", width, gram, most).collect()], key=str)
    assert got == repeats([tuple(r) for r in docs.select("doc_id", "text").collect()], width)


def test_suffix_dedup_more_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted([(r.row, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.without_repeats(with_row_key(rows)).collect()], key=str)
    assert got == repeats([tuple(r) for r in rows.collect()], 400)


def test_suffix_dedup_odd(odd, none):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(odd).collect()]
    assert sorted(got, key=str) == repeats([(r.doc_id, r.text) for r in odd.collect()], 400)
    assert suffix_dedup.remove_repeats(none).count() == 0


# 4 mixing


def test_mixing_meets_targets(docs):
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    source = docs.toPandas().set_index("doc_id")["source"].fillna("~null")
    by = got.assign(source=got["doc_id"].map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert (abs(by["taken"] - by["target"]) <= by["most"]).all()
    assert abs(by["target"].sum() - min(1.5 * by["size"].sum(), 2 * by["size"].sum())) < 1e-3 * by["target"].sum()


def test_mixing_odd(odd, none):
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(none).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns


def test_dual_equals_bisection(spark):
    """The multiplier of each source from the definition: sum of n * size * min(cap, exp(lam * size / mean)) is the target."""
    rng = np.random.default_rng(2)
    rows = [(key, int(size), int(rng.integers(1, 9))) for key in "abc" for size in rng.choice(np.arange(1, 400), 12, replace=False)]
    total = {key: sum(s * n for k, s, n in rows if k == key) for key in "abc"}
    wanted = {"a": 0.4, "b": 1.7, "c": 1.01}
    got = {r.key: r for r in mixing.solve_dual(
        spark.createDataFrame(rows, "key string, size long, n long"),
        spark.createDataFrame([(k, total[k], total[k] * w) for k, w in wanted.items()], "key string, source_size long, target double"), 2.0).collect()}
    for key, share in wanted.items():
        own = [(s, n) for k, s, n in rows if k == key]
        mean = sum(s * n for s, n in own) / sum(n for _, n in own)
        low, high = -1e4, 1e4
        for _ in range(200):
            lam = (low + high) / 2
            tokens = sum(n * s * min(2.0, np.exp(min(50, lam * s / mean))) for s, n in own)
            low, high = (lam, high) if tokens < share * total[key] else (low, lam)
        assert abs(got[key].mean - mean) < 1e-9 and abs(got[key].lam - lam) < 1e-5


# 5 rules


def test_rules_do_not_depend_on_order(docs):
    rules = quality_rules.default_rules()
    rows = quality_rules.with_statistics(docs)
    one, two = (rows.withColumn("v", quality_rules.verdict(r)).filter("v").count() for r in (rules, rules[::-1]))
    assert one == two


def test_rules_odd(odd, none):
    got = quality_rules.apply_rules(odd.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(None)))
    assert {r.kept_input for r in got.collect()} == {"mine"} and set(quality_rules.RESULTS) <= set(got.columns)
    assert got.count() == odd.count() and got.filter("doc_id in (0, 1, 2) and not base_failed").isEmpty()
    assert quality_rules.apply_rules(none).count() == 0


# 6 classifier


def test_passages_hold_their_own_words():
    """Words of a passage by the byte that they start at, for texts of several passages."""
    random.seed(9)
    texts = [" ".join(random.choice(["aa", "b", "ccc", "word", "é"]) for _ in range(n)) for n in (900, 0, 3, 400)] + ["x" * 3000, None]
    x, counts = quality_model.passages(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        raw = (text or "").encode()
        for k in range(n):
            starts = [i for i in range(k * quality_model.PASSAGE, min(len(raw), (k + 1) * quality_model.PASSAGE)) if raw[i : i + 1] != b" " and (i == 0 or raw[i - 1 : i] == b" ")]
            size = min(len(raw), (k + 1) * quality_model.PASSAGE) - k * quality_model.PASSAGE
            assert abs(x[at + k, -3] - len(starts) / size) < 1e-6
        at += n
    assert at == len(x)


def test_attention_equals_plain_loops_and_gradients_are_right():
    rng = np.random.default_rng(5)
    counts, labels = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    starts, x = np.array([0, 3, 4]), rng.normal(size=(8, 5))
    model = quality_model.Model(np.zeros(5), np.ones(5), quality_model.drawn(5, 4, 3, 1))
    p = model.weights
    want = []
    for a, n in zip(starts, counts, strict=True):
        h = [np.tanh(v @ p["W"] + p["b"]) for v in x[a : a + n]]
        e = np.array([np.sum(p["w"] * np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) for v in h])
        e = np.exp(e) / np.exp(e).sum()
        want.append(1 / (1 + np.exp(-(sum(w * v for w, v in zip(e, h, strict=True)) @ p["c"] + p["d"][0]))))
    assert np.allclose(model.forward(x, starts, counts)["y"], want)

    def loss():
        y = model.forward(x, starts, counts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for k, g in quality_model.gradients(model, x, starts, counts, labels).items():
        flat, grad = p[k].reshape(-1), np.asarray(g).reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            before = flat[i]
            flat[i] = before + 1e-6
            up = loss()
            flat[i] = before - 1e-6
            down = loss()
            flat[i] = before
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-6


def test_scores_are_those_of_the_fitted_forward_pass(monkeypatch):
    """Values beyond the clip count alike in fitting and scoring; neighbours in a batch and runs of a long text do not."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["plain", "words", "####", "A1,", "e" * 30]) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    labels = np.array([float("####" in t[:200]) for t in texts])
    x, counts = quality_model.passages(texts)
    x[3, :] = 1e4  # far beyond what is usual
    model = quality_model.fit(x.astype(np.float64), counts, labels, rounds=20)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    fitted = model.forward(model.standard(x), starts, counts)["y"]
    assert np.abs(model.standard(x)).max() <= quality_model.CLIP
    x2, _ = quality_model.passages(texts)
    same = model.forward(model.standard(x2), starts, counts)["y"]
    assert np.allclose(model.scores(texts), same) and np.allclose(fitted[5:], same[5:])
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])
    long = "word " * 1000 + "next " * 1000
    want = quality_model.passages([long[k : k + 1200] for k in range(0, len(long), 1200)])[0]
    monkeypatch.setattr(quality_model, "RUN", 1200)
    parts, owner = quality_model.parts_of([None, long, "", "x"])
    assert "".join(parts) == long + "x" and owner.tolist() == [1] * 9 + [3]
    f = model.forward(model.standard(want), np.array([0]), np.array([len(want)]))
    assert np.allclose(model.scores(["a", long, None])[1], f["y"])


def test_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = quality_model.query(spark, folder).join(labels, "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() / got.count() > 0.95


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (5, 1), (7, 0), (8, 0), (9, 1)], "doc_id long, quality int")
    model = quality_model.train(odd, labels)
    got = quality_model.score(odd.drop("score"), model)
    assert got.filter("score is null or score < 0 or score > 1").isEmpty() and got.count() == odd.count()
    assert quality_model.train(odd, labels.limit(0)) is None and quality_model.keep_quality(odd.drop("score"), labels.limit(0)).count() == odd.count()
    assert quality_model.score(none.drop("score"), model).count() == 0


# 7 top-k


def test_top_k(spark):
    random.seed(2)
    rows = [(k, [random.choice([-1.0, 0.5, 0.25]) for _ in range(4)], 0) for k in range(400)] + [(400, None, 0), (401, [float("nan")] * 4, 0), (402, [1.0, None, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (420, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    v = df.select("vec_id", topk.rounded(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    got = [tuple(r) for r in topk.top_k(v, v.filter("vec_id % 20 = 0"), 20, slice_queries=7).orderBy("query_id", "rank").collect()]
    full = {r.vec_id: list(r.v) + [0] * (4 - len(r.v)) for r in v.collect()}
    want = []
    for q in sorted(full):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(full[q], full[c], strict=True)), c) for c in full if c != q)[:20]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# 8 MinHash


def test_minhash_equals_sql(docs, spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    want = sorted(con.execute(minhash.SQL).fetchall())
    got = sorted(tuple(r) for r in minhash.query(spark, small_dir).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want


def near_group(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_minhash_links_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 40)
    texts = near_group(150, 60, 8, 1) + near_group(30, 20, 3, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {k: top(k) for k in range(len(texts))}


def test_minhash_odd(odd, none):
    got = minhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.filter("doc_id in (0, 1, 2) and component_id != doc_id").isEmpty()
    assert {r.component_id for r in got.filter("doc_id in (5, 6)").collect()} == {5}
    assert minhash.drop_near_duplicates(odd).columns == odd.columns and minhash.drop_near_duplicates(odd).filter("doc_id = 4").count() == 1
    assert minhash.near_duplicates(none).count() == 0


# 9 packing


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    got = packing.pack_documents(docs, path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    tokens = 0
    for d, text in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        own = got[got["doc_id"] == d].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"].iloc[:-1] == 2048).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == np.concatenate(([0], s["length"].cumsum()[:-1])).tolist() and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.02 * -(-tokens // 2048) + 1


def test_bin_completion_beats_best_fit():
    counts = {7: 2, 5: 2, 3: 2, 2: 2, 6: 1}
    patterns, lower = packing.bin_completion(counts, 10)
    assert sum(n for _, n in patterns) >= lower
    used = Counter()
    for items, n in patterns:
        assert sum(items) <= 10
        used.update({x: k * n for x, k in Counter(items).items()})
    assert dict(used) == counts and sum(n for _, n in patterns) <= sum(n for _, n in packing.best_fit(counts, 10))


def test_least_bins_is_no_more_than_best_fit_and_sees_large_pieces():
    assert packing.least_bins({6: 3, 5: 1}, 10) == 4 and packing.least_bins({}, 10) == 0
    assert packing.least_bins({7: 2, 4: 2, 3: 1}, 10) == 3  # 25 of room 30, and neither 4 fits beside a 7
    assert packing.least_bins({7: 3, 4: 3}, 10) == 5  # by size alone 4
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 20): rng.randint(1, 5) for _ in range(rng.randint(1, 6))}
        assert -(-sum(x * n for x, n in counts.items()) // 20) <= packing.least_bins(counts, 20) <= sum(n for _, n in packing.best_fit(counts, 20))


def test_bin_completion_saves_bins():
    """Histograms of bins that were full before they were cut: the search often finds what best fit does not."""
    saved = 0
    rng = random.Random(8)
    for _ in range(60):
        counts = Counter()
        for _ in range(6):  # six full bins, cut at random
            cuts = sorted(rng.sample(range(10, 91), 3))
            counts.update(b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True))
        patterns, lower = packing.bin_completion(dict(counts), 100)
        found, plain = sum(n for _, n in patterns), sum(n for _, n in packing.best_fit(counts, 100))
        assert lower <= found <= plain
        saved += found < plain
    assert saved >= 20


def test_encoder_keeps_to_its_budget_and_equals_the_tokenizer():
    """Letters of one and two bytes, marks, digits, whatever else; remembered or not, in runs or not."""
    encoder = packing.ChunkEncoder(packing.default_tokenizer(), most_bytes=20_000)
    plain = encoder.tokenizer
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids
    rng = random.Random(2)
    letters = "abcXYZéÀÞßñ÷×.,;!7 42'<>|@#-\t\n\x0b\x1c\x85…¿日本ŒœİK\u0301\u00a0𝔘ﬁ½²Ⅷ"
    assert not encoder.whole
    texts = ["".join(rng.choice(letters if k % 3 else "abcdé., ") for _ in range(rng.randint(0, 300))) for k in range(400)]
    texts += ["", " ", "<|endoftext|> and <|startoftext|>x", "I'll we've it's", "\n".join(["end."] * 3)]
    for k in range(0, len(texts), 9):
        for t, got in zip(texts[k : k + 9], encoder.encode(texts[k : k + 9]), strict=True):
            assert got.tolist() == ids(t), t
        assert encoder.known.bytes < 20_000 + 9 * 300 * 60  # what one call adds goes at its end
    assert encoder.known.clock > 40 and encoder.encode([]) == []
    for t in texts[:200]:
        parts = list(packing.parts_of(t, 40))
        assert "".join(parts) == t and [i for p in parts for i in ids(p)] == ids(t)


def test_long_texts_are_encoded_in_runs(monkeypatch):
    encoder = packing.ChunkEncoder(packing.default_tokenizer())
    texts = [None, "short", "a long text, " * 90_000, "", "z" * 1_100_000 + " end", "last"]
    for t, got in zip(texts, packing.encoded(encoder, texts), strict=True):
        assert got.tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_tokenizer_of_other_rules_encodes_whole_texts():
    import public_tokenizers

    encoder = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = " Two  Words, and\n\nmore. "
    assert encoder.whole and encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_odd(odd, none):
    got = packing.pack_documents(odd, packing.default_tokenizer())
    assert got.filter("doc_id in (0, 1) and length != 1").isEmpty() and got.select("doc_id", "piece").distinct().count() >= 11
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0


def test_bin_completion_equals_exhaustive_search():
    def least(lengths, room):
        """Fewest bins by trying every bin for every piece, largest first."""
        best = [len(lengths)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(bins)
                return
            for b in {r: i for i, r in enumerate(bins) if r >= lengths[k]}.values():
                place(k + 1, [*bins[:b], bins[b] - lengths[k], *bins[b + 1 :]])
            place(k + 1, [*bins, room - lengths[k]])

        place(0, [])
        return best[0]

    random.seed(12)
    for _ in range(60):
        room = random.choice([10, 20, 37])
        lengths = sorted((random.randint(1, room) for _ in range(random.randint(1, 11))), reverse=True)
        patterns, lower = packing.bin_completion(dict(Counter(lengths)), room)
        assert sorted((x for items, n in patterns for x in items * n), reverse=True) == lengths and all(sum(items) <= room for items, _ in patterns)
        assert lower <= sum(n for _, n in patterns) == least(lengths, room)


# 10 personal data


def test_base_spans():
    text = "mail a.b@c.example.com, ip 10.0.0.256 10.0.0.255, card 4111 1111 1111 1111 4111111111111112, call +1 (201) 555-0123."
    found = [(personal_data.KINDS[k], text[s:e]) for s, k, e in personal_data.base_spans(text)]
    assert found == [("email", "a.b@c.example.com"), ("ip", "10.0.0.255"), ("phone", "+1 (201) 555-0123")]  # both cards are one run of 32 digits
    assert personal_data.redact("x a@b.co y", personal_data.joined(personal_data.base_spans("x a@b.co y"))) == "x <email> y"
    assert personal_data.base_spans("9" * 50000 + "." + "@" * 1000) == []


def test_mails_in_long_runs():
    """5 MB without a blank take a time that is linear in their length; matches are those of the plain pattern."""
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("ab.@@-_ é+") for _ in range(rng.randint(0, 60)))
        assert list(personal_data.emails(text)) == [m.span() for m in plain.finditer(text)]
    began = time.process_time()
    long = "a" * 5_000_000
    assert list(personal_data.emails(long + "@b")) == [] and list(personal_data.emails(long + "@b.c" + long)) == [(0, 10_000_004)]
    assert list(personal_data.emails("@".join("a" * 50 for _ in range(100_000)))) == []
    assert time.process_time() - began < 5


def test_base_spans_equal_the_plain_patterns(docs):
    import re

    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(digits):
        doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(digits[::-1])]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for (t,) in docs.select("text").collect():
        found = personal_data.base_spans(t or "")
        assert [(s, e) for s, k, e in found if k == 0] == [m.span() for m in email.finditer(t or "")]
        assert [(s, e) for s, k, e in found if k == 1] == [m.span() for m in ip.finditer(t or "") if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for s, k, e in found if k == 2] == [m.span() for m in card.finditer(t or "") if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
        assert [(s, e) for s, k, e in found if k == 3] == [m.span() for m in phone.finditer(t or "") if 10 <= len(digits(m)) <= 15]


def segmentations(text, field):
    """(score, segments, features) of every segmentation of a text, listed one by one."""
    s, labels = personal_data.segments(text), len(personal_data.KINDS) + 1
    n = len(s.places)
    scores = field.scores(s.features.astype(float), s.entity)

    def from_token(t, before):
        if t == n:
            yield 0.0, []
            return
        for end in range(t, n):
            for label in range(labels) if end == t else range(1, labels):
                if label == 0 or s.entity[end, end - t]:
                    for more, rest in from_token(end + 1, label):
                        yield field.moves[before, label] + scores[end, end - t, label] + more, [(t, end, label), *rest]

    return s, list(from_token(0, 0))


def test_field_equals_all_segmentations():
    rng = np.random.default_rng(4)
    labels, features = len(personal_data.KINDS) + 1, len(personal_data.NAMES)
    for text in ("a@b.c 1", "x 12345 y", "(at) 4567", "10.2.3.44"):
        field = personal_data.Field(rng.normal(size=(features, labels)), rng.normal(size=(labels, labels)))
        s, every = segmentations(text, field)
        best = max(every, key=lambda e: e[0])[1]
        assert field.decode(text) == [(s.places[a][0], label - 1, s.places[b][1]) for a, b, label in best if label]
        one = lambda f: f.expectations(s.features[None], s.entity[None], np.array([len(s.places)]))
        whole, expected, moved = one(field)
        assert abs(whole[0] - np.log(np.sum(np.exp([e for e, _ in every])))) < 1e-9
        for name, want in (("weights", expected), ("moves", moved)):
            for i, j in rng.integers(0, labels, (6, 2)):
                up, down = (personal_data.Field(field.weights.copy(), field.moves.copy()) for _ in range(2))
                getattr(up, name)[i, j] += 1e-5
                getattr(down, name)[i, j] -= 1e-5
                assert abs((one(up)[0][0] - one(down)[0][0]) / 2e-5 - want[i, j]) < 1e-5


def test_stretches_and_blocks_change_nothing(docs, monkeypatch):
    """Spans of stretches, of long stretches in short blocks and of whole texts decoded at once are the same."""
    field = personal_data.fit(personal_data.examples_of(personal_data.invented()))
    texts = [r.text for r in docs.select("text").collect() if r.text][:80]
    texts += ["no 1 at " + "w " * 40 + "call (559) 555-3817 or x(at)y.org " + "v " * 40 + "7", " ".join(str(k * 7919) for k in range(900))]
    for text in texts:
        whole = field.decode(text)
        monkeypatch.setattr(personal_data, "BLOCK", 17)
        assert [x for a, b in personal_data.stretches(text) for x in field.decode(text, a, b)] == whole
        monkeypatch.undo()


def test_field_finds_rewritten_spans(spark):
    """Recall and false alarms on windows of other documents, with spans rewritten into forms that the patterns miss or that are none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field, seen = personal_data.train(docs, fit_windows=50), set(personal_data.sample_windows(docs, fit_windows=50))
    asked = [w for w in personal_data.sample_windows(docs, fit_docs=1000, fit_windows=2000, seed="held out") if w not in seen]
    hits, wanted, alarms, none = 0, 0, 0, 0
    for k, w in enumerate(asked):
        spans = personal_data.base_spans(w)
        for variant in range(3) if len(spans) == 1 else ():
            text, truth = personal_data.rewritten(w, spans[0], k + variant)
            found = personal_data.find(text, field)[1]
            if truth and truth[0] not in personal_data.base_spans(text):
                hits, wanted = hits + (truth[0] in found), wanted + 1
            elif not truth and not personal_data.base_spans(text):
                alarms, none = alarms + bool(found), none + 1
    print(f"recall {hits} of {wanted}, false alarms {alarms} of {none}")
    assert wanted > 5 and hits / wanted > 0.8 and alarms <= 0.1 * none


def test_field_learns_base_and_more(spark, docs):
    field = personal_data.train(docs)
    got = personal_data.personal_data(docs, field).select("base", "spans").collect()
    assert all(set(r.base.split(",")) <= set(r.spans.split(",")) for r in got if r.base)
    text = "call (559) 555-3817 now"
    assert [text[s:e] for s, k, e in personal_data.find(text, field)[1]] == ["(559) 555-3817"]
    assert personal_data.find("version 3.0.1 of 2024-01-05, page 12", field)[1] == []


def test_personal_data_odd(odd, none):
    field = personal_data.train(none)
    assert personal_data.personal_data(odd.withColumn("spans", F.lit("mine")), field).select("spans_input", "spans").count() == odd.count() and personal_data.personal_data(none, field).count() == 0


# the pipeline


def test_pipeline(spark, small_dir):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, small_dir).cache()
        assert got.columns == docs.columns and got.count() > 0
        if name != "mixing":
            assert got.count() <= docs.count()
        docs = got
    assert "sequence_id" in corpus_pipeline.STAGES[4][1](spark, docs, small_dir).columns


def test_pipeline_stages_keep_the_right_rows(spark, small_dir):
    """Stages that drop rows, each against a plain version over its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{small_dir}/labels.parquet").select("doc_id", "quality")
    good, fresh, single = (stage for _, stage in corpus_pipeline.STAGES[:3])

    scores = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    kept = good(spark, docs, small_dir).cache()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores if r.score >= quality_model.THRESHOLD)

    con = duckdb.connect()
    con.register("documents", kept.select("doc_id", "text").toPandas())
    want = {k: digest for k, _, exact, near, digest in con.execute(line_dedup.SQL).fetchall()}
    blank = {hashlib.sha256(t.encode()).hexdigest() for t in ("", "\n", "\n\n")}
    whole = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()}
    left = fresh(spark, kept, small_dir).cache()
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in left.collect()}
    assert all(got[k] == want[k] for k in got)
    assert all(want[k] != whole[k] and want[k] in blank for k in want.keys() - got.keys())

    rows = {r.doc_id: (r.text or "").lower() if (r.text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in r.text) for r in left.collect()}
    grams = {}
    for k, t in rows.items():
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        grams[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(grams[a] & grams[b])
            if shared and 100 * shared >= 80 * (len(grams[a]) + len(grams[b]) - shared):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in single(spark, left, small_dir).collect()) == [k for k in ids if root[k] == k]
