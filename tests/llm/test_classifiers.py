"""Quality, toxicity and language on held-out rows of the small tables, and their edge cases."""

import numpy as np
import pytest

from causeway.llm import langid, quality, toxicity
from causeway.llm.common import LabelledSample, labelled_sample, table

BAD = ["worthless", "idiot", "pathetic", "moron"]


def sample_of(rows):
    return LabelledSample(rows, [None] * len(rows), {0: 1.0, 1: 1.0})


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = np.random.default_rng(1)
    words = ["the", "house", "river", "and", "stone", "walks", "green", "letter", "often", "under", "mountain", "speaks"]
    rows, labels = [], []
    for i in range(400):
        own = list(rnd.choice(words, 60))
        if i % 4 == 0:
            for k in rnd.integers(0, 60, 4):
                own[k] = BAD[int(rnd.integers(0, 4))]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    rows = [(i, t if y else " | ".join(t.split())) for (i, t), (_, y, _) in zip(rows, labels, strict=True)]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns(spark, labelled):
    docs, labels = labelled
    found = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["toxic"]).mean() > 0.95


def test_quality_learns(spark, labelled):
    docs, labels = labelled
    found = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.95


def test_windows_hold_the_whole_text_and_overlap():
    for n in (0, 1, 39, 40, 41, 63, 64, 65, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        windows = toxicity.windows_of(text)
        assert all(w == text.encode()[24 * i : 24 * i + 40] for i, w in enumerate(windows))
        assert b"".join(w[:24] for w in windows[:-1]) + (windows[-1] if windows else b"") == text.encode()
    assert toxicity.windows_of(None) == []


def test_distances_equal_compressed_lengths(labelled):
    """Every window's distance against plain compression with either dictionary, and features against counts."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert model.usable and len(model.pairs) > 1
    scorer = toxicity.Scorer(model)
    for text in [r["text"] for r in docs.limit(20).collect()] + ["", None, "x" * 5000]:
        wanted = []
        for w in toxicity.windows_of(text):
            each = [len(toxicity._compressor(o)(w)) - len(toxicity._compressor(t)(w)) for t, o in model.pairs]
            wanted.append(sum(each) if each[0] >= toxicity.GATE else 0)
        got = scorer.distances(text)
        assert got.tolist() == wanted
        hits = [sum(d >= t for d in wanted) for t in model.thresholds]
        assert np.allclose(toxicity.features(got, model.thresholds)[6:], np.log1p(hits))


def test_it_is_no_list_of_words(labelled):
    """Toxic words run into others, cut or with marks in them still count: windows are compressed, not looked up."""
    docs, labels = labelled
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    plain = "the house river and stone walks green letter often under mountain speaks " * 3
    glued = plain + "theworthlesshouse pathetically riverpathetic idiotic worthlessness anidiotand green patheticworthless " + plain
    assert scorer.score(glued) > 0.5 > scorer.score(plain)


def test_scores_do_not_move_with_the_shares_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 5) for i in range(300)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 10 == 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    sample = labelled_sample(docs, labels, "quality", 5, 0, 20, 1 << 20, "n_chars")
    number = {y: sum(v == y for _, v in sample.rows) for y in (0, 1)}
    held = {r["doc_id"]: r["quality"] for r in labels.collect() if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5}
    assert number[0] == 20 and {y: round(sample.weight[y] * number[y]) for y in (0, 1)} == {y: sum(v == y for v in held.values()) for y in (0, 1)}
    assert set(sample.lengths) == {5}


def test_quality_sees_the_metadata_when_it_learns():
    rnd = np.random.default_rng(4)
    rows, lengths = [], []
    for i in range(300):
        rows.append((" ".join(rnd.choice(["aa", "bb", "cc", "dd"], 30)) + f" {i}", i % 2))
        lengths.append(5 if i % 2 else 500_000)
    model = quality.fit(LabelledSample(rows, lengths, {0: 1.0, 1: 1.0}))
    score = lambda n: quality.raw_score(model, *(lambda at, x: (at, quality._scaled(model, x)))(*quality.inputs("aa bb cc dd " * 8, n, {})))
    assert score(5) > 0 > score(500_000)


def test_sum_of_squares_identity():
    rnd = np.random.default_rng(0)
    size = len(quality.STATISTICS) + 30
    model = quality.Model(rnd.normal(size=size), rnd.normal(size=(size, 8)), np.zeros(1), np.ones(1))
    at, x = np.arange(0, size, 3), rnd.normal(size=len(range(0, size, 3)))
    pairs = sum(model.vector[at[i]] @ model.vector[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(quality.raw_score(model, at, x) - (model.weight[at] @ x + pairs)) < 1e-9


def test_scores_of_odd_rows(spark, labelled, docs, empty):
    _, labels = labelled
    model = toxicity.train(*labelled)
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1] < 0.5
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.classify(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    good = quality.train(*labelled)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, good).collect())
    assert {r["predicted"] for r in quality.classify(docs, labels.limit(0)).collect()} == {1}


def test_language_on_held_out_rows(spark, data):
    docs = table(spark, data, "documents")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97 and found["score"].between(0, 1).all()


def test_forward_sum_equals_all_segmentations():
    from public_tokenizers import path

    pieces = langid.pieces(path(langid.VOCABULARY))
    rnd = np.random.default_rng(2)
    p = rnd.random((pieces.size + 1, 2)) / 100
    number = {n: i for i, n in enumerate(pieces.names)}

    def total(text, at=0):
        if at == len(text):
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(text) - at + 1):
            if text[at : at + k] in number:
                out = out + p[number[text[at : at + k]]] * total(text, at + k)
        if text[at] not in number:
            out = out + p[-1] * total(text, at + 1)
        return out

    words = ["the", "straße", "house", "ﬁx", "zzqq", "a"]
    assert np.allclose(langid.score_words(p, pieces, words), [np.log(total(langid.MARK + w)) for w in words])


def test_sums_of_words_of_any_length_equal_log_space():
    """Words of 25 to 5,000 letters against a plain forward pass in logarithms, and expected counts against brute force."""
    from public_tokenizers import path

    pieces = langid.pieces(path(langid.VOCABULARY))
    rnd = np.random.default_rng(3)
    p = rnd.random((pieces.size + 1, 3)) ** 4 / 1000 + 1e-9
    number = {n: i for i, n in enumerate(pieces.names)}

    def log_sum(word):
        text = langid.MARK + word
        ahead = np.full((len(text) + 1, 3), -np.inf)
        ahead[0] = 0.0
        for end in range(1, len(text) + 1):
            for k in range(1, min(end, pieces.depth) + 1):
                x = number.get(text[end - k : end], len(pieces.names) if k == 1 else None)
                if x is not None:
                    ahead[end] = np.logaddexp(ahead[end], ahead[end - k] + np.log(p[x]))
        return ahead[-1]

    words = ["donaudampfschifffahrtsgesellschaftskapitaen", "a", "x" * 5000, "the" * 700, "日本語" * 300]
    words += ["".join(rnd.choice(list("etaoinshrdlu"), n)) for n in (25, 26, 31, 32, 33, 64, 100, 1000, 5000)]
    assert np.allclose(langid.score_words(p, pieces, words), [log_sum(w) for w in words], rtol=1e-9)
    one, h = p[:, :1], 1e-5
    short = ["therein", "straße"] + ["".join(rnd.choice(list("etaoin"), n)) for n in (9, 40, 120)]
    times = np.arange(1.0, len(short) + 1)
    got = langid.expected_counts(one, pieces, short, times)
    value = lambda q: float(times @ langid.score_words(q, pieces, short)[:, 0])
    for x in np.argsort(-got)[:12]:
        more, less = one.copy(), one.copy()
        more[x] *= 1 + h
        less[x] *= 1 - h
        assert abs((value(more) - value(less)) / (2 * h) - got[x]) < 1e-4 * max(1.0, got[x])
    assert langid.words_of("x" * 99 + " y") == ["x" * 99, "y"]


def test_language_of_odd_rows(spark, docs, empty):
    rows = langid.identify(docs).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {0, 1, 2, 3, 9, 13} and len(rows) == docs.count()
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.count() == docs.count() - 6 and kept.columns == docs.columns
