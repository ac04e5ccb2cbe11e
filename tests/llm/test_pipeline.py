"""The pipeline's stages against brute force, each on what its predecessor kept."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from common import by_row, sentence, words
from test_corpus import features, kept_lines, level_targets, near_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randint(4, 40)) for _ in range(rng.randint(1, 5)))
        out.append([i, text, "en", f"s{i % 5}"])
    out[7][1], out[9][1], out[11][1] = "short", None, " ".join(["again and"] * 40)
    out[20][1] = out[3][1]
    w = out[4][1].split(" ")
    out[21][1] = " ".join([*w[:3], "swapped", *w[4:]])
    out[22][1] = out[5][1] + "\n" + out[6][1]
    out[23][3] = None
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 60, 3)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def lines_removed(docs):
    stay, out = kept_lines(docs), []
    for r in docs:
        parts = r[1].split("\n")
        keep = stay[r[0] is None, r[0], r[1]]
        if keep or not any(words(x) for x in parts):
            text = "\n".join(x for i, x in enumerate(parts) if i in keep or not words(x))
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def one_of_each(docs):
    _, root = near_classes(docs)
    first = {}
    for i, r in sorted(enumerate(docs), key=lambda p: p[1][0]):
        first.setdefault(root[i], r)
    return list(first.values())


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "dedup_lines", "one_of_near_copies", "mix_sources", "encode_pieces"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = rows()
    for name, brute in (("quality_rules", lambda d: [r for r in d if features(r[1])[-1]]), ("dedup_lines", lines_removed), ("one_of_near_copies", one_of_each)):
        docs = stages[name](spark, docs, sf_dir)
        assert docs.columns == COLUMNS
        got, now = docs.collect(), brute(now)
        assert by_row(got, *COLUMNS) == collections.Counter(now), name
        docs = spark.createDataFrame(now, docs.schema)

    mixed = stages["mix_sources"](spark, docs, sf_dir).collect()
    sizes = collections.Counter()
    for r in now:
        sizes[r[3]] += len(words(r[1]))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    expected = level_targets(sizes, weights, 3, sum(sizes.values()))
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += len(words(r.text))
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(len(words(r[1])) for r in now if r[3] == s)
    assert set(map(tuple, mixed)) <= set(now) and max(collections.Counter(map(tuple, mixed)).values()) <= 3

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    encoded = collections.Counter()
    for r in mixed:
        ids = lib.encode(r.text)
        encoded[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += 1
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert by_row(corpus_pipeline.run(spark, sf_dir).collect(), *names) == encoded


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_odd_documents(spark, sf_dir):
    """Null identifiers, sources and texts, repeated rows, a very long text, and extra columns of clashing names."""
    rng = random.Random(9)
    long = "\n".join(sentence(rng, 50) for _ in range(900))
    plain = "\n".join(sentence(rng, 30) for _ in range(3))
    odd = [(None, sentence(rng, 40), "s1"), (None, sentence(rng, 40), "s1"), (None, None, None), (5, "", "s2"), (6, None, "s2"), (7, long, None), (8, plain, "s1"), (8, plain, "s1"), (9, plain, "s1")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, kept int, t_ string, result__ int, copies string, each int"
    made = [(i, t, "en", s, None if t is None else len(t), "clash", k, "t", None, "c", 1) for k, (i, t, s) in enumerate(odd)]
    docs = spark.createDataFrame(made, schema)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [f.split(" ")[0] for f in schema.split(", ")]
        rows = docs.collect()
        seen.append(len(rows))
        assert all(r.row_key == "clash" and r.each == 1 and (r.text is None or r.n_chars == len(r.text)) for r in rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    # null and empty texts fail the rules; the later equal lines of 9 and one row of 8 go; no null identifier is lost
    assert seen[:3] == [6 - (features(long)[-1] is False), 5 - (features(long)[-1] is False), 4 - (features(long)[-1] is False)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
