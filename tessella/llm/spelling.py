"""Operator 12: spelling variants grouped by a frequency-vector trie.

Words are maximal runs of letters (``[A-Za-z\\u00C0-\\u00FF]+``), with only A-Z put in
lower case; those of ``shortest`` code points and ``least`` occurrences are compared.
Words are near if they differ by one inserted, missing or replaced code point. A
word's form is its near word of most occurrences (ties: the smallest) if it has at
least ``times`` as many; its root is the end of the chain of forms.

The trie arranges words by the counts of successive letter groups (see ``count_trie``).
Its top levels are a shuffle: words are stored under the counts of the first groups,
and visit, besides their own subtree, those that one surplus and one deficit reach; of
two subtrees only the words of the lesser key visit, so each pair meets once. The
number of levels is the least with which no subtree has more than ``leaf`` words; where
the deepest keep more, a subtree is held in several parts that all are visited. Below, a
task searches its subtree depth-first for blocks of visitors, and checks the leaves.

Tasks return, per word, the number of near words and the best of them, so pairs are
never stored. Chains of forms are halved by joins, a written table per round.

Defined results: a null or empty text has no words; equal rows count each; a null
identifier is an empty string in the hash that chooses typing errors (``slips``);
without slips it isn't looked at; extra columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import count_trie
from tessella.llm.common import small_batches, written

SHORTEST, LEAST, TIMES = 5, 3, 2
#: Words of a subtree in one task, levels of the trie at most that are shuffled, and bits of a count in a key.
LEAF, LEVELS, BITS = 16_384, 8, 4
#: Words of a task's counts before they are handed on, and visitors that are searched together.
HELD, VISITORS = 200_000, 32_768

#: Byte of a Latin-1 text to the letter it counts as, or to a space.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode("utf-8")


def _count(shortest: int, slips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def batch() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # other characters become "?", which is no letter, so each byte is a code point
                runs = Counter(text.encode("latin-1", "replace").translate(_LETTER).split())
                start = zlib.crc32(f"{name}:".encode())
                for word, n in runs.items():
                    if len(word) < shortest:
                        continue
                    if slips:
                        h = zlib.crc32(_utf8(word), start)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    held[word] += n
                if len(held) > HELD:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slips: int = 0) -> DataFrame:
    """(word, n) of docs (doc_id, text). ``slips``: one word of a document in so many, chosen by a hash, loses a letter."""
    small_batches(docs.sparkSession)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if slips else F.lit("")
    rows = docs.filter("text is not null").select(name.alias("name"), "text")
    counts = rows.mapInArrow(_count(shortest, slips), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _top_counts(word: Column) -> Column:
    """The counts of the first LEVELS letter groups, BITS each, the first one highest."""
    key = F.lit(0).cast("bigint")
    for letter in count_trie.LETTERS[:LEVELS]:
        n = F.char_length(word) - F.char_length(F.translate(word, letter, ""))
        key = key * (1 << BITS) + F.least(n, F.lit((1 << BITS) - 1))
    return key


def subtree_levels(keys: DataFrame, leaf: int = LEAF) -> int:
    """The least number of levels with which no subtree has more than ``leaf`` words, or LEVELS."""
    per_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level")
    prefix = F.expr(f"shiftright(key, int({BITS} * ({LEVELS} - level)))").alias("prefix")
    sizes = per_key.select("key", "n", level).groupBy("level", prefix).agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n"))
    return min((r["level"] for r in sizes.collect() if r["n"] <= leaf), default=LEVELS)


def _reached(levels: int) -> Column:
    """The greater keys of ``levels`` counts that one surplus and one deficit reach, besides the key itself; some don't exist."""
    digit = lambda i: F.shiftright("key", BITS * (levels - 1 - i)).bitwiseAND((1 << BITS) - 1)
    unit = lambda i: 1 << (BITS * (levels - 1 - i))
    more = [F.when(digit(i) < (1 << BITS) - 1, F.col("key") + unit(i)) for i in range(levels)]
    # one up at i and one down at a later j gives a greater key
    both = [F.when((digit(i) < (1 << BITS) - 1) & (digit(j) > 0), F.col("key") + unit(i) - unit(j)) for i in range(levels) for j in range(i + 1, levels)]
    return F.array_compact(F.array(F.col("key"), *more, *both))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by subtree and part, its own words before visitors; returns what each word has found there."""
    current, own, guests = None, [], []
    stored: count_trie.Words | None = None
    counts: list[int] = []

    def found(words: list[tuple[bytes, int, bool]]) -> Iterator[tuple[bytes, int, int, bytes]]:
        """Near pairs of the stored words with visitors, or (where these are the same list) among themselves."""
        asked = stored if words is own else count_trie.Words([w for w, _ in words])
        here: dict[int, list] = {}
        there: dict[int, list] = {}

        def add(to: dict, who: int, n: int, word: bytes) -> None:
            if (best := to.get(who)) is None:
                to[who] = [1, -n, word]
            else:
                best[0] += 1
                if (-n, word) < (best[1], best[2]):
                    best[1:] = [-n, word]

        for i, j in count_trie.near_pairs(stored, asked):
            if words is own:
                add(here, i, own[j][1], own[j][0])  # both orders of a pair are met
            else:
                add(here, i, words[j][1], words[j][0])
                add(there, j, own[i][1], own[i][0])
        for rows, of in ((here, own), (there, words)):
            for who, (k, less, word) in rows.items():
                yield of[who][0], k, -less, word

    def batch(rows) -> pa.RecordBatch:
        words, k, n, best = zip(*rows)
        text = lambda ws: pa.array([w.decode("latin-1") for w in ws], pa.string())
        return pa.RecordBatch.from_arrays([text(words), pa.array(k, pa.int64()), pa.array(n, pa.int64()), text(best)], names=["word", "k", "best_n", "best"])

    def searched() -> Iterator[pa.RecordBatch]:
        nonlocal stored, guests
        if stored is None and own:
            stored = count_trie.Words([w for w, _ in own])
            if rows := list(found(own)):
                yield batch(rows)
        if stored is not None and guests and (rows := list(found(guests))):
            yield batch(rows)
        guests = []

    for b in batches:
        for place, guest, word, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            if place != current:
                yield from searched()
                current, own, guests, stored = place, [], [], None
            if guest:
                guests.append((word.encode("latin-1"), n))
                if len(guests) >= VISITORS:
                    yield from searched()
            else:
                own.append((word.encode("latin-1"), n))
    yield from searched()


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have near words; best: of largest n, then the smallest."""
    spark = words.sparkSession
    keyed = words.withColumn("full_key", _top_counts(F.col("word")))
    levels = subtree_levels(keyed.select(F.col("full_key").alias("key")), leaf)
    keyed = keyed.withColumn("key", F.shiftright("full_key", BITS * (LEVELS - levels))).drop("full_key")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / float(leaf)).cast("int").alias("parts"))
    sizes = written(sizes.withColumnRenamed("key", "reached"), "subtrees")  # written, so that the join of a frequent key is a plain one, which Spark splits
    visits = keyed.select("word", "n", "key", F.explode(_reached(levels)).alias("reached")).join(sizes, "reached")
    part = F.pmod(F.xxhash64("word"), "parts").cast("int")
    visits = visits.select("word", "n", "key", "reached", part.alias("own_part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    at_home = F.col("key") == F.col("reached")
    visits = visits.filter(~at_home | (F.col("part") >= F.col("own_part")))  # parts of one subtree: the lesser visits the greater
    place = (F.col("reached") * (1 << 24) + F.col("part")).alias("place")
    visits = visits.select(place, (~at_home | (F.col("part") != F.col("own_part"))).alias("guest"), "word", "n")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = visits.repartition(shuffles, "place").sortWithinPartitions("place", "guest")
    found = dealt.mapInArrow(_search, "word string, k bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the ends of the chains, which have no form of their own. Forms grow in n, so chains end.

    Each round a word's pointer becomes its pointer's pointer, so a chain of k takes about log2(k) rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def group(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, slips: int = 0, leaf: int = LEAF) -> DataFrame:
    """word, n, form, form_n, root, n_near of every word of docs (doc_id, text)."""
    words = written(vocabulary(docs, shortest, least, slips), "words")
    near = near_words(words, leaf)
    rows = words.join(near, "word", "left")
    taken = F.col("best_n") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    rows = written(rows, "forms")
    ends = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
