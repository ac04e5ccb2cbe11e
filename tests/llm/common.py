"""Small documents with every odd case, and plain-Python references."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, slot int, row_key string, copies int, w_ string, entries__ string"


def sentence(rng, n):
    syllables = ["the", "ra", "ion", "é", "ß", "ver", "Ñu", "st", "ab", "q"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts():
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(12, 90)) for _ in range(12)]
    out = [None, "", "  \t\n ", "one", "two words", "\n\n", "a\n\nb\n a", "tabs\tand\r\nbreaks\x0bhere\x0c.", "<|endoftext|> it's <s> 12,3.4!! ▁x \x00 İI ﬁ é 　z"]
    out += base
    words = base[0].split(" ")
    out += [" ".join(words[:5] + ["changed"] + words[6:]), " ".join(words[:9] + words[10:]), base[0], base[0]]
    out += [base[1] + "\n" + base[2] + "\n" + base[1], "\n".join([base[3]] * 4), "Σίσυφος ΣΑΣ. " + base[4], "🎵" * 40 + " " + base[5]]
    long = " ".join(sentence(rng, 60) for _ in range(160))
    out += [long, long[:40_000] + "\n" + long[300:5_000], "x" * 3_000 + " " + "nospace" * 900]
    return out


def odd_rows():
    rows = []
    for i, t in enumerate(texts()):
        source = None if i % 7 == 3 else f"s{i % 4 if i % 3 else 0}"
        rows.append((i, t, None if i % 5 == 0 else "en", source, None if t is None else len(t), "clash", i, "k", 9, None, "e"))
    rows += [(None, "a row without an identifier and some more words to read here", "en", "s1", 1, None, None, None, None, None, None)] * 2
    rows += [rows[10]] * 3 + [(3, "same identifier, another text", "en", "s2", 5, None, None, None, None, None, None)]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows, *columns):
    """Rows as a multiset of tuples, nulls allowed."""
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(text)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()
