"""Spelling variants: the filter's neighbourhoods and the registered query against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexmill.llm import queries, variants


def edits_apart_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, misspelt=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(rows, misspelt=199):
    """All words against all words that share a first or a last half (one edit leaves one half as it is)."""
    words = brute_words(rows, misspelt)
    halves = defaultdict(set)
    for w in words:
        for cut in {len(w) // 2, (len(w) + 1) // 2, (len(w) - 1) // 2}:
            halves["a", w[:cut]].add(w)
            halves["b", w[cut:]].add(w)
    near = defaultdict(set)
    for some in halves.values():
        for a in some:
            near[a] |= {b for b in some if a != b and b not in near[a] and edits_apart_by_one(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variant_texts(rng):
    """Chains of variants with falling counts, ties, accented letters and capitals."""
    text = []
    for _ in range(40):
        word = "".join(rng.choice("abcdeéÀß") for _ in range(rng.randrange(6, 12)))
        count = 700
        while count >= 3:
            text += [word] * count
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + "z" + word[at:], word[:at] + "ÿ" + word[at + 1 :]])
            count //= rng.choice([2, 5, 6])
    rng.shuffle(text)
    return [(i, " ".join(w.upper() if w.isascii() and i % 3 else w for w in text[at : at + 100])) for i, at in enumerate(range(0, len(text), 100))]


@pytest.mark.parametrize("words", [["bookkeeper"], ["aaaaaaa"], ["éàÿbcd", "zzzzzz"]])
def test_edits_are_the_deletions_and_later_replacements(words):
    length = len(words[0])
    own, found = variants.neighbours(words, length, lambda n, h: h == h)
    letters = [chr(c) for c in variants.LETTERS]
    expected = {(w, w[:i] + w[i + 1 :]) for w in words for i in range(length)}
    expected |= {(w, w[:i] + c + w[i + 1 :]) for w in words for i in range(length) for c in letters if letters.index(c) > letters.index(w[i])}
    assert sorted(zip(own, found)) == sorted(expected)


def test_hashes_of_edits_are_those_of_the_words():
    word = "variantß"
    shorter = [word[:i] + word[i + 1 :] for i in range(len(word))]
    assert variants.deletions(variants.codes([word], 8))[0].tolist() == variants.hashes(variants.codes(shorter, 7)).tolist()


@pytest.mark.parametrize("blocks", [variants.MOST_BLOCKS, 20])
def test_variants_equal_brute_force(documents, monkeypatch, blocks):
    """Also where the filter is far too small for its words and lets most edits through."""
    monkeypatch.setattr(variants, "MOST_BLOCKS", blocks)
    rows = variant_texts(random.Random(3)) + [(5000, None), (5001, ""), (5002, "12 34 -- ..."), (None, "nobody owns " * 6), (7, "repeated rows " * 3), (7, "repeated rows " * 3)]
    got = result(variants.spelling_variants(documents(rows), misspelt=199))
    assert got == brute(rows)
    assert any(root not in (word, form) for word, form, root, *_ in got)


def test_empty_table_and_no_words(documents):
    assert result(variants.spelling_variants(documents([(1, "x")]).where("false"))) == []
    assert result(variants.spelling_variants(documents([(1, "short words only"), (2, None)]))) == []


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op13_spelling_variants"](spark, folder)) == brute(rows)
