"""Spelling variants against all pairs, and the bound of affected grams against all edits."""

import random
import zlib
from collections import Counter

from causeway.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {a: min(near[a], key=lambda b: (-words[b], b)) for a in words if near[a]}
    form = {a: b for a, b in form.items() if words[b] >= 2 * words[a]}
    out = set()
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out.add((a, form.get(a), root, words[a], len(near[a]), words.get(form.get(a))))
    return out


def drawn(rnd, count, letters="abé"):
    words = {}
    while len(words) < count:
        words["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9)))] = rnd.choice([3, 3, 4, 6, 8, 20])
    return words


def test_groups_equal_all_pairs(spark):
    rnd = random.Random(8)
    for letters in ("abé", "ab", "abcdefgh"):
        words = drawn(rnd, 110, letters)
        found = spelling.group(spark.createDataFrame(list(words.items()), "word string, n bigint"))
        assert {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(words)


def test_one_edit_spares_a_chosen_gram():
    """Whatever the dictionary, one of the two chosen grams of a word is among those of every word one edit away, in its place or one further."""
    rnd = random.Random(9)
    for _ in range(300):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 10)))
        frequent = {g: rnd.randint(1, 99) for g in {("^" + word + "$")[i : i + q] for i in range(len(word) + 2) for q in (2, 3, 4)} if rnd.random() < 0.6}
        chosen = spelling._choose(spelling.decompose(word, frequent), frequent)
        assert len(chosen) == 2 and spelling.affected(chosen) == 1
        for at in range(len(word) + 1):
            for c in "abcz":
                for other in (word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]):
                    grams = set(spelling.decompose(other, frequent))
                    shifts = (0, 1) if len(other) > len(word) else (0,)
                    if len(other) >= len(word):
                        assert any((g, p + s) in grams for g, p in chosen for s in shifts)


def test_words_of_odd_texts(spark, docs, empty):
    docs = docs.unionByName(spark.createDataFrame([(None, "nobody knows")], "doc_id bigint, text string"), allowMissingColumns=True)
    found = spelling.runs(docs)
    rows = found.select("id", "run", spelling.misspelled(found).alias("word")).collect()
    assert sum(r["run"] == "hello" for r in rows) == 3 and ("x" * 20000 in {r["run"] for r in rows}) and None in {r["id"] for r in rows}
    for r in rows:
        h = zlib.crc32(f"{'' if r['id'] is None else r['id']}:{r['run']}".encode())
        k = h % len(r["run"])
        assert r["word"] == (r["run"][:k] + r["run"][k + 1 :] if h % 97 == 0 else r["run"])
    assert spelling.variants(empty).count() == 0
    assert {r["word"]: r["n"] for r in spelling.variants(docs).collect()} == {w: n for w, n in Counter(r["word"] for r in rows).items() if n >= 3 and len(w) >= 5}


def test_case_letters_and_bounds(spark):
    """A-Z alone are lowered, letters go from U+00C0 to U+00FF, and words of four letters or two occurrences are left out."""
    texts = ["ÄRGER Ärger ÄRGER STRASSE straße Straße straße tree tree tree apple apple"]
    found = {r["word"]: r["n"] for r in spelling.counted(spelling.runs(spark.createDataFrame([(1, texts[0])], "doc_id bigint, text string")), spelling.F.col("run")).collect()}
    assert found == {"Ärger": 3, "straße": 3}


def test_long_chain_of_forms(spark):
    words = [("a" * 5 + "b" * i, 3 * 2 ** (20 - i)) for i in range(20)]
    found = {r["word"]: r["root"] for r in spelling.group(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert set(found.values()) == {"aaaaa"}
