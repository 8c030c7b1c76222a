"""SimHash components and personal data against brute force, and the pipeline."""

import hashlib
import re
import time

import numpy as np
import xxhash

from causeway.llm import pii, simhash
from causeway.llm.common import table


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(x for x in groups[root(k)] if x is not None) if any(x is not None for x in groups[root(k)]) else None for k, i in enumerate(ids)}


def test_components_equal_brute_force(spark, data, docs, empty):
    rows = table(spark, data, "documents").select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    wanted = brute_components([r["doc_id"] for r in rows], prints)
    got = {r["doc_id"]: r for r in simhash.components(table(spark, data, "documents")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == wanted
    assert all(got[r["doc_id"]]["fingerprint"] == f"{p:016x}" for r, p in zip(rows, prints, strict=True))
    odd = simhash.components(docs)
    assert odd.count() == docs.count() and odd.where("doc_id in (0, 1, 2, 3)").select("component_id").distinct().collect()[0][0] == 0
    assert simhash.components(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text = 'Hello, world.'").count() == 1 and kept.where("doc_id is null").count() == 1


def test_every_pair_of_three_bits_meets():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rnd.choice(64, int(rnd.integers(0, 4)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    a, b = [set() for _ in x], [set() for _ in x]
    for (rows, keys), out in ((simhash.keys_of(x), a), (simhash.keys_of(y), b)):
        for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
            out[r].add(k)
    assert all(p & q for p, q in zip(a, b, strict=True))


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[::97]
    low, high, leader = simhash._leaders()
    code = words ^ leader[low[words & 4095] ^ high[words >> 12]]
    assert (low[code & 4095] == high[code >> 12]).all() and np.bitwise_count(words ^ code).max() <= 3


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            holds = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if holds:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


HARD = [
    "a@b.c_d@e.f.g, x@y@z.w", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "😀 4111-1111-1111-1111 é 4111 1111 1111 1112", "+1 (123) 555-0101 +12 +1234567890123456 + 1234567890",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and password: hunter2hunter2", "call (415) 555-0132 today", "@a.b a@.b a@b a@b. a@b.c.", "9" * 5000, "1." * 4000, "a@b" + ".c" * 4000, "x" * 60000 + "@y.z", "",
]


def test_base_spans_equal_brute_force(spark, docs, empty):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    for frame in (hard, docs.where("doc_id <> 5").select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        rows = pii.find(frame).collect()
        assert len(rows) == len(texts)
        for r in rows:
            wanted = brute_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest(), (texts[r["doc_id"]], r["spans"], wanted)
            assert set(wanted) <= set(r["spans"].split(",")) | {""}
            assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in wanted) for k in PATTERNS]
    assert pii.find(empty).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (212) 555-01{i:02d} now") for i in range(30)]
    rows += [(100 + i, f'api token = "{hashlib.md5(str(i).encode()).hexdigest()}" kept') for i in range(30)]
    rows += [(200 + i, f"serial 4111 1111 1111 11{i:02d} of part") for i in range(15, 40)]
    docs = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "doc_id bigint, text string, _spans string, pii int, `found.email` string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert all("secret:" in found[100 + i] for i in range(30))
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and {tuple(r)[2:] for r in redacted.collect()} == {("x", 7, "y")}
    clean = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert clean[3] == "write to <EMAIL> or call <PHONE> now" and clean[100] == 'api token = "<SECRET>" kept'


def test_many_addresses_in_one_text(spark):
    """Places stay right over many blocks, and time stays in proportion."""
    took = []
    for n in (2000, 16000):
        text = " ".join(f"é{i}@mail{i}.org" for i in range(n))
        start = time.time()
        row = pii.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
        took.append(time.time() - start)
        assert row["n_email"] == n and row["base_sha256"] == hashlib.sha256(",".join(brute_spans(text)).encode()).hexdigest()
    assert took[1] < 8 * took[0] + 5


def test_pipeline_on_the_small_tables(spark, data):
    import corpus_pipeline

    docs = table(spark, data, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, data)
        assert kept.columns == corpus_pipeline.COLUMNS
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids and 0 < len(ids) < docs.count()


def test_each_stage_on_odd_rows(spark, data, docs, empty):
    """Nulls in any column, empty and long texts, repeated rows and ids, an empty table, and extra columns."""
    import corpus_pipeline

    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data)
        assert kept.columns == corpus_pipeline.COLUMNS and stage(spark, empty, data).count() == 0, name
        got = [tuple(r) for r in kept.collect()]
        if name == "toxicity":
            assert sorted(got, key=str) == sorted(rows, key=str)
        elif name == "language":
            assert sorted(r[0] for r in got if r[0] is not None) == [4, 5, 5, 6, 7, 8, 10, 11, 12, 14] and None in [r[0] for r in got]
        elif name == "near duplicates":
            assert sorted(r[0] for r in got if r[0] is not None) == [0, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14] and None in [r[0] for r in got]
        else:
            assert len(got) == len(rows) and {r[1] for r in got if r[0] == 12} == {"mail me at <EMAIL>, call <PHONE> or <IP>"}
    packed = corpus_pipeline.pack_windows(spark, docs, data)
    assert packed.where("doc_id is not null").select("doc_id").distinct().count() == 15 and corpus_pipeline.pack_windows(spark, empty, data).count() == 0
