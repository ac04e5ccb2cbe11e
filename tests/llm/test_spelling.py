"""Operator 12: the trie against all pairs, and the operator against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from common import no_docs, odd_docs, odd_rows
from tessella.llm import count_trie, spelling

LOWER = {65 + i: 97 + i for i in range(26)}


def random_words(rng, n):
    return sorted({"".join(rng.choice("aéetnx") for _ in range(rng.randint(1, 6))).encode("latin-1") for _ in range(n)})


def test_one_apart_against_all_edits():
    rng = random.Random(1)
    words = random_words(rng, 400)
    letters = "aéetnx".encode("latin-1")
    for a in words[::7]:
        reach = {a[:i] + a[i + 1 :] for i in range(len(a))}
        reach |= {a[:i] + bytes([c]) + a[i + k :] for i in range(len(a) + 1) for c in letters for k in (0, 1) if i + k <= len(a)}
        reach.discard(a)
        assert {b for b in words if count_trie.one_apart(a, b)} == reach & set(words)


def test_trie_finds_all_pairs(monkeypatch):
    rng = random.Random(2)
    for block, pairs in ((1, 7), (64, 1 << 20), (1 << 13, 50)):
        monkeypatch.setattr(count_trie, "BLOCK", block)
        monkeypatch.setattr(count_trie, "PAIRS", pairs)
        stored, asked = random_words(rng, 150), random_words(rng, 150) + [b"a" * 300, b"a" * 299]
        got = list(count_trie.near_pairs(count_trie.Words(stored), count_trie.Words(asked)))
        expected = {(i, j) for i, a in enumerate(stored) for j, b in enumerate(asked) if count_trie.one_apart(a, b)}
        assert len(got) == len(set(got)) and set(got) == expected and expected


def test_many_words_of_one_vector_come_in_slices(monkeypatch):
    monkeypatch.setattr(count_trie, "PAIRS", 50)
    words = [("ab" * k + "ba" * (9 - k) + c).encode() for k in range(10) for c in ("x", "")]
    words = sorted(set(words)) + sorted({b"".join(p) for p in itertools.permutations([b"ae", b"it", b"on", b"rs"])})
    stored = count_trie.Words(words)
    sizes = [len(i) for i, _ in count_trie._expanded(stored, stored, *(np.concatenate(x) for x in zip(*count_trie.near_vectors(stored.vectors, stored.vectors))))]
    assert max(sizes) <= 50
    expected = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if count_trie.one_apart(a, b)}
    got = list(count_trie.near_pairs(stored, stored))
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) == 20


def plain(rows, slips, shortest, least):
    counts = Counter()
    for name, text in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if k >= least and len(w) >= shortest}
    raw = {w: w.encode("latin-1") for w in n}
    near = {w: [x for x in n if count_trie.one_apart(raw[w], raw[x])] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], form.get(w), n.get(form.get(w)), root(w), len(near[w])) for w in n}


def found(df):
    return {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in df.collect()}


def test_groups_against_plain_python(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["the", "ra", "én", "ion", "Ñu", "x\u00d7"]) for _ in range(rng.randint(1, 3))) for _ in range(120)]
    words += [w[:i] + w[i + 1 :] for w in words[:60] for i in (1, 3)]
    texts = [" ".join(rng.choices(words, k=80)).swapcase() if i % 5 == 0 else "-".join(rng.choices(words, weights=range(len(words), 0, -1), k=200)) for i in range(40)]
    rows = [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)] + [(3, None), (4, ""), (5, "Ünïcode 的的的的的 🎵abcde")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = plain(rows, 5, 4, 2)
    assert any(v[1] and v[3] != v[1] for v in expected.values())  # chains of several forms
    for leaf in (3, 40, 10_000):  # parts of one subtree, several subtrees, one
        assert found(spelling.group(df, 4, 2, slips=5, leaf=leaf)) == expected


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert found(spelling.group(odd_docs(spark), slips=97)) == plain(rows, 97, 5, 3)
    assert found(spelling.group(odd_docs(spark))) == plain(rows, 0, 5, 3)
    assert spelling.group(no_docs(spark)).count() == 0


def test_chains_end_at_their_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [(f"x{i}", "w0") for i in range(300)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert len(got) == 313 and set(got.values()) == {"w13"}
