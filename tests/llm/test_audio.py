"""Operator 9: alignment of cut and noisy recordings, and blocks against brute force."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import audio_match, chroma


def tune(seed, n=48):
    rng = np.random.default_rng(seed)
    t = np.arange(256) / audio_match.RATE
    return np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (p / 12) * t) * np.hanning(256) for p in rng.integers(0, 12, n)])


def pcm(x):
    return (np.clip(x, -1, 1) * 20000).astype("<i2").tobytes()


def recordings():
    rng = np.random.default_rng(0)
    rows = [(i, pcm(tune(i))) for i in range(30)]
    rows += [(100, pcm(tune(3)[256 * 6 :])), (101, pcm(tune(20) + rng.normal(0, 0.03, len(tune(20)))))]
    rows += [(120, None), (140, b""), (160, b"\0" * 999), (None, pcm(tune(5))), (20, pcm(tune(20)))]
    return rows


def test_fingerprints_align_with_offset():
    a, b = (chroma.fingerprint(chroma.frames(x, audio_match.RATE)) for x in (tune(3), tune(3)[256 * 6 :]))
    found = chroma.Stack([a]).aligned(b, 10, 0.25)
    assert [(f[0], f[1]) for f in found] == [(0, 6)] and found[0][2] < 0.01
    assert chroma.Stack([a]).aligned(chroma.fingerprint(chroma.frames(tune(4), audio_match.RATE)), 10, 0.25) == []


def test_bit_errors():
    a = np.array([1, 2, 3], dtype=np.uint32)
    assert chroma.bit_errors(a, a, 0) == (0, 3) and chroma.bit_errors(a, a, 1) == (3, 2) and chroma.bit_errors(a, a, 5) == (0, 0)


def brute(rows, every):
    prints = [(i, chroma.fingerprint(chroma.frames(np.frombuffer((x or b"")[: len(x or b"") // 2 * 2], "<i2") / 32768, audio_match.RATE))) for i, x in rows]
    out = {}
    for q, a in {i: p for i, p in prints if i is not None and i % every == 0}.items():
        best, n = [], 0
        for i, b in prints:
            if i == q:
                continue
            errors = []
            for shift in range(-len(a), len(b)):
                wrong, m = chroma.bit_errors(a, b, shift)
                if m >= min(audio_match.MIN_OVERLAP, len(a), len(b)) and m and wrong <= audio_match.MAX_ERROR * 32 * m:
                    errors.append(wrong / (32 * m))
            if errors:
                n += 1
                best.append((min(errors), i))
        out[q] = (n, min(best)[0] if best else None)
    return out


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audio_match, "BLOCK_ROWS", 7)
    df = spark.createDataFrame(recordings(), "id bigint, audio binary").withColumn("block", F.lit("clash"))
    prints = audio_match.fingerprints(df)
    for rows in (7, 1000):
        got = {r.id: r for r in audio_match.align(prints, prints.filter("id % 20 = 0"), rows).collect()}
        expected = brute(recordings(), 20)
        assert set(got) == set(expected)
        found = sum(got[q].n_matches for q in got)
        assert found >= 0.9 * sum(n for n, _ in expected.values()) and all(got[q].n_matches <= expected[q][0] for q in got)
    assert got[20].best_id == 101 and got[20].n_matches >= 1
    assert got[120].n_matches == got[140].n_matches == 0


def test_empty_and_odd_vectors(spark):
    empty = spark.createDataFrame([], "id bigint, audio binary")
    assert audio_match.search(empty).count() == 0
    vectors = spark.createDataFrame([(0, [0.1] * 64), (20, None), (40, [0.5, None] * 32), (60, [])], "vec_id bigint, v array<float>")
    rows = audio_match.search(audio_match.sung(vectors, "vec_id", "v")).collect()
    assert sorted(r.id for r in rows) == [0, 20, 40, 60]


def noisy(seed, share, bits=32):
    """Fingerprint-like integers, and a copy in which every position has ``share`` of its bits flipped."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2, (40, bits))
    b = a.copy()
    for row in b:
        row[rng.choice(bits, round(share * bits), replace=False)] ^= 1
    return [(x << np.arange(bits, dtype=np.uint64)).sum(1).astype("<u4") for x in (a.astype(np.uint64), b.astype(np.uint64))]


def test_bit_errors_in_every_integer_are_found(spark):
    pairs = [noisy(s, share) for s, share in enumerate((0.1, 0.15, 0.2, 0.25))]
    rows = [(20 * i, a.tobytes()) for i, (a, _) in enumerate(pairs)] + [(1000 + i + 1, b[3:].tobytes()) for i, (_, b) in enumerate(pairs)]
    prints = spark.createDataFrame(rows, "id bigint, print binary")
    got = {r.id: r for r in audio_match.align(prints, prints.filter("id < 1000"), 3).collect()}
    assert {q: [(m.id, m.offset, m.overlap) for m in r.matches] for q, r in got.items()} == {20 * i: [(1001 + i, -3, 37)] for i in range(4)}


def test_stack_against_brute_force():
    rng = np.random.default_rng(5)
    prints = [chroma.fingerprint(chroma.frames(tune(s, int(n)), audio_match.RATE)) for s, n in enumerate(rng.integers(30, 60, 24))]
    stack, found = chroma.Stack(prints), 0
    for q in prints[:8]:
        expected = []
        for who, b in enumerate(prints):
            tries = [(wrong / (32 * n), -n, shift) for shift in range(-len(q), len(b)) for wrong, n in [chroma.bit_errors(q, b, shift)] if n >= 11 and wrong <= 0.3 * 32 * n]
            if tries:
                rate, n, shift = min(tries)
                expected.append((who, shift, rate, -n))
        assert stack.aligned(q, 11, 0.3) == expected
        found += len(expected)
    assert found > 8


def test_all_matches_are_returned_by_class(spark):
    rows = [(0, pcm(tune(3))), (1, pcm(tune(3))), (2, pcm(tune(3)[256 * 6 :])), (3, pcm(tune(3)[256 * 6 :])), (4, pcm(tune(3)[256 * 9 :])), (5, pcm(tune(9)))]
    out = audio_match.search(spark.createDataFrame(rows, "id bigint, audio binary")).collect()
    of = {r.id: r["class"] for r in out}
    assert len(out) == 6 and of[0] == of[1] and of[2] == of[3] and len(set(of.values())) == 4
    (r,) = [r for r in out if r.matches is not None]
    assert r.id == 0 and r.n_matches == 4 and [(m["class"], m.recordings, m.offset) for m in r.matches] == [(of[1], 1, 0), (of[2], 2, -6), (of[4], 1, -9)]
    assert r.matches[0].id == 1 and r.best_id == 1


def test_short_recordings_are_compared_whole():
    rng = np.random.default_rng(8)
    whole = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
    part, other = whole[11:19].copy(), rng.integers(0, 1 << 32, 8, dtype=np.uint32)
    part[3] ^= np.uint32(0b111)
    stack = chroma.Stack([whole, other, part])
    assert stack.aligned(part, audio_match.MIN_OVERLAP, 0.25) == [(0, 11, 3 / 256, 8), (2, 0, 0.0, 8)]
    assert stack.aligned(whole, audio_match.MIN_OVERLAP, 0.25) == [(0, 0, 0.0, 40), (2, -11, 3 / 256, 8)]


def test_short_copies_and_repeated_ids(spark):
    rows = [(0, pcm(tune(1, 24))), (1, pcm(tune(1, 24))), (20, pcm(tune(3))), (20, pcm(tune(4))), (7, pcm(tune(3))), (8, pcm(tune(4)))]
    out = [r for r in audio_match.search(spark.createDataFrame(rows, "id bigint, audio binary")).collect() if r.matches is not None]
    assert sorted((r.id, r.best_id, r.n_matches) for r in out) == [(0, 1, 1), (20, 7, 1), (20, 8, 1)]
    assert [r.matches[0].overlap for r in out if r.id == 0] == [6]


def test_long_silence_stays_bounded(spark):
    """Equal frames hit everywhere; the recordings of one length of silence are one class, and others align at every offset."""
    rows = [(i, pcm(np.zeros(256 * (400 + i % 5) + 1024))) for i in range(60)]
    out = [r for r in audio_match.search(spark.createDataFrame(rows, "id bigint, audio binary")).collect() if r.matches is not None]
    assert sorted(r.id for r in out) == [0, 20, 40] and all(r.n_matches == 59 and r.best_error == 0 for r in out)


def test_many_queries_at_once_against_brute_force():
    """Lengths on both sides of where transforms are turned back by a matrix, and where they are in double precision."""
    rng = np.random.default_rng(12)
    prints = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (7, 46, 46, 46, 170, 640)]
    for p, share in zip(list(prints), (0.1, 0.2, 0.24, 0.25, 0.2, 0.24)):
        flips = rng.random((len(p), 32)) < share
        prints.append((p ^ (flips.astype(np.uint32) << np.arange(32, dtype=np.uint32)).sum(1, dtype=np.uint32))[len(p) // 5 :])
    prints += [np.zeros(46, dtype=np.uint32), np.zeros(170, dtype=np.uint32), np.empty(0, dtype=np.uint32)]
    got = list(zip(*(c.tolist() for c in chroma.Stack(prints).matches(prints, 20, 0.25))))
    expected = []
    for q, a in enumerate(prints):
        for who, b in enumerate(prints):
            least = max(1, min(20, len(a), len(b)))
            tries = [(wrong / (32 * n), -n, shift) for shift in range(-len(a), len(b)) for wrong, n in [chroma.bit_errors(a, b, shift)] if n >= least and wrong <= 0.25 * 32 * n]
            if tries:
                rate, n, shift = min(tries)
                expected.append((q, who, shift, rate, -n))
    assert got == expected and len({(q, w) for q, w, *_ in got if q != w}) >= 10


def test_matches_of_a_query_stay_together():
    """The visit gives a row per query and block, however many recordings match there, also in a block without recordings."""
    whole = np.random.default_rng(3).integers(0, 1 << 32, 60, dtype=np.uint32).astype("<u4")
    held = [(0, False, f"c{i}", whole[i:].tobytes(), i, i, 1) for i in range(30)]
    asks = [(block, True, f"c{i}", whole[i:].tobytes(), None, None, None) for block in (0, 1) for i in (0, 20)]
    schema = pa.schema([("block", pa.int32()), ("asks", pa.bool_()), ("class", pa.string()), ("print", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("rows", pa.int64())])
    batches = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in held + asks], schema).to_batches(max_chunksize=7)
    rows = [r for b in audio_match._visit(iter(batches)) for r in b.to_pylist()]
    assert [(r["asked"], len(r["found"])) for r in rows] == [("c0", 30), ("c20", 30), ("c0", 0), ("c20", 0)]
    assert [(m["class"], m["least"], m["offset"], m["error"], m["overlap"]) for m in rows[1]["found"]][:21:20] == [("c0", 0, 20, 0.0, 40), ("c20", 20, 0, 0.0, 40)]
