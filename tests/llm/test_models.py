from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from taxaloom.llm import langid, lm, quality
from taxaloom.llm.queries import op2_quality_classifier, op4_lm_scoring, op6_language_id
from taxaloom.llm.textarrays import Words

MEDIUM = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (2, "  \n"), (3, "one"), (4, "x" * 30000), (5, "a b " * 9000), (5, "a b " * 9000), (6, "12 34 !!")]


def test_words():
    w = Words(["The cat\tsat", "", "a b C"], lower=True)
    assert np.diff(w.word_offsets).tolist() == [3, 0, 2]
    again = Words(["c the"], lower=True).hashes
    assert w.hashes[4] == again[0] and w.hashes[0] == again[1]


def test_quality_held_out(spark):
    out = op2_quality_classifier(spark, MEDIUM)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert [r.quality_score for r in quality.score(docs, model).collect()] == [0.5] * len(ODD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    many = docs.union(spark.createDataFrame([(i, "good plain words here " * i if i % 2 else "### $$$ " * i, 1) for i in range(7, 40)], "doc_id long, text string, score int"))
    s = quality.score(many, quality.fit(many, labels)).collect()
    assert len(s) == 33 + len(ODD) and all(np.isfinite(r.quality_score) for r in s)
    assert quality.keep(many, labels).columns == many.columns
    assert quality.score(docs.limit(0), model).count() == 0


def plain_statistics(text):
    """What quality.statistics gives, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, sizes = len(w), [len(x) for x in w]
    logit = lambda k, of: math.log((k + 0.5) / (max(of - k, 0) + 0.5))
    same = lambda back: sum(a == b for a, b in zip(w[back:], w, strict=False))
    upper = lambda c: "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7"
    lower = lambda c: "a" <= c <= "z" or c >= "\xdf" and c != "\xf7"
    classes = [upper, lower, lambda c: c in "#*$%&|<>@^~=+_\\/{}[]", lambda c: "0" <= c <= "9", lambda c: c in "!?", lambda c: c in ",.", lambda c: c == "\n"]
    mean = sum(sizes) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in sizes) / max(n, 1) - mean * mean, 0))
    own = [math.log1p(n), math.log1p(len(set(w))) - math.log1p(n), math.log1p(len(set(zip(w[1:], w, strict=False)))) - math.log1p(n), logit(max(Counter(w).values(), default=0), n), logit(same(1), n), logit(same(2), n), math.log1p(mean), math.log1p(spread)]
    return own + [logit(sum(map(f, text)), len(text)) for f in classes]


def test_quality_brute_force(spark):
    """Statistics counted word by word, and the discriminant from numpy's covariances, determinants and solutions."""
    r = np.random.default_rng(5)
    words = ["plain", "words", "Über", "x,", "#$", "12", "why?", "a", "end.", "\n"]
    texts = [" ".join(r.choice(words, size=int(r.integers(0, 120)), p=np.roll(np.linspace(1, 19, 10) / 100, 5 * (i % 2)))) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(80) if i % 9], "doc_id long, quality int, toxic int")
    x = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(x, quality.statistics(texts))
    learn = np.array([i for i in range(80) if i % 9 and zlib.crc32(str(i).encode()) % 5])
    centre, scale = x[learn].mean(0), np.maximum(x[learn].std(0), 1e-3)
    z, density = (x - centre) / scale, []
    for c in (0, 1):
        own = z[[i for i in learn if i % 2 == c]]
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.trace(cov) / cov.shape[0] * np.eye(cov.shape[0])
        gap = z - own.mean(0)
        density.append(-0.5 * (gap * np.linalg.solve(cov, gap.T).T).sum(1) - 0.5 * np.linalg.slogdet(cov)[1])
    n, prior = np.expm1(x[:, 0]), np.mean(learn % 2)
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) * n / (n + quality.FEW_WORDS) + np.log(prior / (1 - prior)), -700, 700)))
    got = {d.doc_id: d.quality_score for d in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert np.allclose([got[i] for i in range(80)], want, atol=1e-4)
    kept = {d.doc_id for d in quality.keep(docs, labels).collect()}
    assert kept == {i for i in range(80) if got[i] >= quality.THRESHOLD} and 0 < len(kept) < 80


def test_language_held_out(spark):
    out = op6_language_id(spark, MEDIUM)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in out.collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.95


def test_language_profile_is_a_bundle():
    text = "the cat"
    code, doc, lettered = langid.trigrams([text, "12", ""])
    v = langid.letter_vectors().astype(int)
    at = lambda ch: int(langid.letter_classes()[ord(ch)])
    slow = np.zeros(langid.DIMENSIONS, int)
    padded = " " + text + " "
    for i in range(1, len(padded) - 1):
        if at(padded[i]):
            slow += np.roll(v[at(padded[i - 1])], 2) * np.roll(v[at(padded[i])], 1) * v[at(padded[i + 1])]
    assert langid.trigram_vectors(code).astype(int).sum(0).tolist() == slow.tolist()
    assert lettered.tolist() == [True, False, False]


def test_language_brute_force(spark):
    """Prototypes and cosines letter by letter."""
    v = langid.letter_vectors().astype(int)
    at = lambda ch: int(langid.letter_classes()[ord(ch)])

    def profile(text):
        p = f" {text} "
        three = [(at(p[i - 1]), at(p[i]), at(p[i + 1])) for i in range(1, len(p) - 1) if at(p[i])]
        return sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in three), np.zeros(langid.DIMENSIONS, int))

    r = np.random.default_rng(6)
    letters = {"xa": list("abcdefg"), "xb": list("cdefghi"), "xc": list("efghijk")}
    rows = [(i, " ".join("".join(r.choice(letters[lang], size=5)) for _ in range(4)), lang) for i, lang in enumerate(list(letters) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    unit = {}
    for lang in letters:
        total = sum(profile(t) for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5)
        unit[lang] = total / np.linalg.norm(total)
    for d in langid.predict(docs, langid.fit(docs)).collect():
        own = profile(d.text)
        cosine = {lang: float(own @ u / np.linalg.norm(own)) for lang, u in unit.items()}
        best = max(cosine, key=cosine.get)
        assert d.lang_pred == best and math.isclose(d.score, min(max(cosine[best], 0), 1), abs_tol=1e-5)


def test_language_edges(spark):
    docs = spark.createDataFrame([(*r, "en" if r[0] != 4 else None) for r in ODD], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert out[None].lang_pred == out[1].lang_pred == out[6].lang_pred == "und" and out[1].score == 0
    assert out[3].lang_pred == "en"
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_lm(spark, sf):
    rows = op4_lm_scoring(spark, sf).collect()
    again = op4_lm_scoring(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    n = sum(r.n_words for r in rows)
    mean = sum(r.pseudo_ll for r in rows) / n
    # About as good as the best prediction without context (the entropy of the symbols) even on this little text.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frequent, counts = lm.vocabulary(docs)
    symbol = np.concatenate([lm.symbols(Words([r.text or ""], lower=True), frequent) for r in docs.select("text").collect()])
    assert counts.tolist() == np.bincount(symbol, minlength=lm.SYMBOLS).tolist()
    p = counts / len(symbol)
    assert len(symbol) == n and mean > (p[p > 0] * np.log(p[p > 0])).sum() * 1.01


def test_lm_brute_force_and_edges(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    frequent, params = lm.fit(docs)
    out = lm.score(docs, (frequent, params)).collect()
    assert len(out) == len(ODD)
    for r in out:
        w = Words([r.text or ""], lower=True)
        s = lm.symbols(w, frequent)
        total = 0.0
        for t in range(min(len(s), 50) if len(s) <= 50 else 0):
            around = [s[t + o] if 0 <= t + o < len(s) else lm.PAD for o in lm.OFFSETS]
            h = np.tanh(params[1] + sum(params[0][k][a] for k, a in enumerate(around)))
            z = h @ params[2] + params[3]
            total += float(z[s[t]] - np.log(np.exp(z).sum()))
        assert r.n_words == len(s)
        if len(s) <= 50:
            assert abs(total - r.pseudo_ll) < 1e-3
    assert lm.score(docs.limit(0), lm.fit(docs.limit(0))).count() == 0


def test_lm_predicts_words_not_buckets(spark, monkeypatch):
    # 150 words, so that some are in buckets; of these, those that the corpus has more often are likelier in the same place.
    common = [f"w{i}" for i in range(lm.FREQUENT)]
    texts = [" ".join(common)] * 9 + ["rareword zzqxj"] + ["rareword"] * 3 + [f"once{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for listed in (lm.LISTED, 114):
        monkeypatch.setattr(lm, "LISTED", listed)
        words, params = lm.fit(docs)
        counts = {t: sum(x.split().count(t) for x in texts) for t in {t for x in texts for t in x.split()}}
        assert len(words.listed) == (len(counts) if listed > 114 else lm.FREQUENT + 1)
        rows = {r.text: r for r in lm.score(docs, (words, params)).collect()}
        w = Words(["rareword", "once7", "zzqxj"], lower=True)
        cls = lm.classes(w, words.frequent)
        assert (cls >= lm.FREQUENT).all()
        given = lm.within_class(w, words)
        pad = np.full((1, len(lm.OFFSETS)), lm.PAD)
        for k, t in enumerate(["rareword", "once7"]):
            assert abs(rows[t].pseudo_ll - lm.log_probabilities(params, pad, cls[k : k + 1])[0] - given[k]) < 1e-3
        in_class = Words(sorted(counts), lower=True)
        same_class = lm.classes(in_class, words.frequent) == cls[0]
        whole = sum(counts[t] for t, ok in zip(sorted(counts), same_class, strict=True) if ok)
        assert abs(given[0] - np.log(4 / (whole + 1))) < 1e-5
        # What listed words leave of a class is shared by spelling; unseen strings that are unlike words get less.
        seen = np.exp(lm.within_class(in_class, words)[same_class]).sum()
        assert seen < 1
        a, b = lm.within_class(Words(["once99"]), words)[0], lm.within_class(Words(["xq#kvz"]), words)[0]
        assert a - words.within[lm.classes(Words(["once99"]), words.frequent)[0]] > b - words.within[lm.classes(Words(["xq#kvz"]), words.frequent)[0]]


def test_lm_spelling_is_a_distribution():
    rng = np.random.default_rng(1)
    table = rng.random((lm.UNITS, lm.UNITS))
    table[:, [*range(97), *range(99, lm.EDGE)]] = 0  # only a, b and the end
    with np.errstate(divide="ignore"):
        table = np.log(table / table.sum(1, keepdims=True)).ravel()
    from itertools import product

    texts = ["".join(p) for n in range(1, 15) for p in product("ab", repeat=n)]
    w = Words([" ".join(texts)])
    total = np.exp(lm.spelled(w, np.arange(len(texts)), table)).sum()
    empty = np.exp(table[lm.EDGE * lm.UNITS + lm.EDGE])
    assert 0.98 < total + empty <= 1 + 1e-9


def test_lm_trains_on_every_word(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 7)
    texts = ["one", "a b", "a b", "a b", None, "", "c d e f g h i j k l", "a " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, _ = lm.vocabulary(docs)
    want = []
    for t in texts:
        s = lm.symbols(Words([t or ""], lower=True), words).tolist()
        want += [(*(s[i + o] if 0 <= i + o < len(s) else lm.PAD for o in lm.OFFSETS), s[i]) for i in range(len(s))]
    for parts in (1, 3):
        rows = lm.gathered(lm.windows(docs, words.frequent, parts), parts).collect()
        assert len({r.part for r in rows}) == len(rows) <= parts
        got = []
        for r in rows:
            code, n = np.frombuffer(r.code, np.uint64), np.frombuffer(r.n, np.int64)
            assert len(np.unique(code)) == len(code)
            got += [tuple(w) for w, k in zip(lm.unpacked(code).tolist(), n, strict=True) for _ in range(k)]
            taught, weight = lm.lesson(code, n)
            total = {}
            for w, x in zip(taught.tolist(), weight, strict=True):
                total[tuple(w)] = total.get(tuple(w), 0) + x
            assert all(abs(total[tuple(w)] - k) < 1e-4 for w, k in zip(lm.unpacked(code).tolist(), n, strict=True))
        assert sorted(got) == sorted(want)


def test_lm_does_not_depend_on_the_cluster(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "PART_WORDS", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    seen = []
    for n in ("4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            words, params = lm.fit(docs.repartition(int(n)))
            seen.append(lm.flat(params))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert np.array_equal(*seen)


def test_lm_gradient():
    rng = np.random.default_rng(5)
    window = rng.integers(0, lm.SYMBOLS, (40, len(lm.OFFSETS) + 1))
    window[0, 0] = lm.PAD
    params = [p.astype(np.float64) for p in lm.initial(np.ones(lm.SYMBOLS))]
    loss = lambda p: -lm.log_probabilities(p, window[:, :-1], window[:, -1]).mean()
    moved = [p.copy() for p in params]
    lm.train(moved, window, 1e-4)
    # A step over windows with weights is that over as many equal windows.
    many, few = ([p.astype(np.float64) for p in lm.initial(np.ones(lm.SYMBOLS))] for _ in range(2))
    lm.train(many, np.repeat(window, 3, axis=0), 1e-2)
    lm.train(few, window, 1e-2, np.full(len(window), 3.0))
    assert all(np.allclose(a, b) for a, b in zip(many, few, strict=True))
    # The first step of Adam is the sign of the gradient.
    for at in [(0, lm.PAD, 3), (1, window[5, 1], 0), (3, window[7, 3], 31)]:
        up, down = [p.copy() for p in params], [p.copy() for p in params]
        up[0][at] += 1e-3
        down[0][at] -= 1e-3
        slope = loss(up) - loss(down)
        assert (moved[0][at] - params[0][at]) * slope < 0


def test_lessons_are_bounded():
    """What a part is trained on follows its different windows, not their counts; the weights hold the counts."""
    r = np.random.default_rng(4)
    code = np.unique(r.integers(0, 1 << 14, 1600).astype(np.uint64))
    for many in (2, 2_000, 2_000_000, 2_000_000_000):
        windows, weight = lm.lesson(code, np.full(len(code), many, np.int64))
        assert len(windows) == len(weight) <= len(code) + lm.STEPS + 128 * 64
        assert np.isclose(weight.sum(dtype=np.float64), many * len(code), rtol=1e-4)
    once, _ = lm.lesson(code << np.uint64(8), np.full(len(code), 2, np.int64))  # every context has one window
    assert len(once) == len(code)
