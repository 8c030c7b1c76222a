"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

from causeway.llm import simhash
from causeway.llm.common import table


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def brute_kept(rows):
    """Smallest id of each component of (id, text) whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets, parent = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (who, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(who)
    return {min(g) for g in groups.values()}


def near_copies():
    """Texts with one to six changed words, some in chains, beside a passage that all share."""
    rnd = random.Random(5)
    rows, common = [], [f"shared{i}" for i in range(40)]
    for g in range(25):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for _ in range(8):
            rows.append((len(rows), " ".join(words + common)))
            words = list(words)
            for _ in range(rnd.randrange(1, 7)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return rows


def test_near_duplicate_stage_keeps_what_brute_force_keeps(spark, data, docs, empty):
    import corpus_pipeline

    made = near_copies()
    frame = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wanted = brute_kept(made)
    assert 25 <= len(wanted) < len(made)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_filter(spark, frame, data).collect()} == wanted
    real = table(spark, data, "documents")
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_filter(spark, real, data).collect()} == brute_kept(rows)
    docs = docs.withColumnsRenamed({"start": "_digest", "id": "_touched"})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text = 'Hello, world.'").count() == 1 and kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(empty).count() == 0


def crowd(seed, n=500, pool=10**6):
    """Copies of one text with up to eight changed, dropped or added words, taken from a pool; some are cut short, some follow another text."""
    rnd = random.Random(seed)
    base, other = ([f"{c}{rnd.randrange(5000)}" for _ in range(110)] for c in "wv")
    texts = set()
    for i in range(n):
        words = list(other[:60] + base[:50] if i % 10 == 9 else base)
        for _ in range(rnd.randrange(9)):
            at, what = rnd.randrange(len(words)), rnd.randrange(4)
            words[at : at + (what != 1)] = [] if what == 0 else [f"x{rnd.randrange(pool)}"]
        texts.add(" ".join(words[: rnd.choice((20, 90, 105)) if i % 7 == 6 else None]))
    return list(enumerate(sorted(texts)))


def test_crowds_of_near_copies_are_not_paired(spark, monkeypatch):
    """Of some hundred near copies few pairs are looked at, and no link is lost."""
    looked_at, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *more: looked_at.append(pairs.count()) or similar(pairs, *more))
    made = crowd(1)
    wanted = brute_kept(made)
    assert 100 < len(wanted) < len(made) - 100
    assert {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(made, "doc_id bigint, text string")).collect()} == wanted
    assert looked_at[-1] < 5 * len(made), looked_at


def test_crowds_lose_no_link(spark):
    """All under one key, each its own component: changes that nobody shares, and changes from a small pool, at several similarities."""
    for seed, pool, similarity, passage in ((2, 10**6, 0.8, 0), (3, 12, 0.8, 0), (4, 40, 0.6, 1), (5, 3, 0.9, 0)):
        texts = [t for _, t in crowd(seed, 250, pool)]
        if passage:
            texts += [" ".join(f"y{i}-{k}" for k in range(i)) + " " + " ".join(f"p{k}" for k in range(60)) for i in range(1, 60)]
        digests = {simhash.digest(t): brute_sets(t) for t in texts}
        apart = spark.createDataFrame([(1, d, d) for d in digests], "key bigint, digest bigint, component bigint")
        own = spark.createDataFrame([(simhash.digest(t), t) for t in texts], "digest bigint, text string")
        linked, met = simhash._met_in_crowds(apart, spark.createDataFrame([], "a bigint, b bigint"), own, 5, similarity)
        alike = {tuple(sorted((a, b))) for a in digests for b in digests if a < b and len(digests[a] & digests[b]) >= similarity * len(digests[a] | digests[b]) - 1e-9}
        linked, met = ({tuple(r) for r in x.collect()} for x in (linked, met))
        assert linked <= alike
        assert component_sets(digests, linked | (met & alike)) == component_sets(digests, alike)


def component_sets(nodes, pairs):
    group = {x: {x} for x in nodes}
    for a, b in pairs:
        if group[a] is not group[b]:
            joined = group[a] | group[b]
            for x in joined:
                group[x] = joined
    return {frozenset(g) for g in group.values()}
