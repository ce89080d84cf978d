r"""Operator 12: phrase collocations from count streams in prefix and suffix order.

A phrase of 2 to ``longest`` words that occurs at least ``least`` times is a
candidate.  Cut into two parts it scores floor(1000 a n / (l r)): a, l, r are
the counts of the phrase and of its parts, n all words of the language.  The
lowest cut counts.  Candidates that a longer candidate covers are dropped.

1. Words are counted by language and spelling.  From then on a word is a 64-bit
   number, its hash; words that share one with a frequent word are looked for
   among all counted words, and if there are any, they get other hashes and the
   step is done again.  So the number of a frequent word is its own.
2. Phrases are counted order by order by the numbers of their words, as far as
   both phrases of one word less may be frequent (a bitmap of hashes says so;
   it never says no wrongly).  These are exact counts, so no scan follows that
   returns every frequent phrase once per task: a frequent phrase is spelled
   once, by joining the words of step 1.  The phrase of no word stands for n.
3. The stream of all counts is put in prefix order (range partitions, sorted by
   words): a phrase follows those it begins with, and those that go on from it
   follow it.  One pass merges the orders in lockstep, a stack holding the open
   phrase of each, and gives every phrase the counts of its beginnings and the
   largest count of a phrase one word longer at the right.
4. The same pass over the stream in suffix order (sorted by words from the
   last) gives the counts of the endings and the extension at the left.  The
   counts of step 3 ride along, so no join by key follows.
   What a partition needs of the one before it is at most one phrase per order,
   filled in from the written table.

A longer phrase that covers a candidate has one word more than it, or contains
one that has and is as frequent, so extensions by one word decide.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and
those into words ``[^\x20\x09]+``; phrases stay inside a piece.  Everything is
counted per language over whole texts.  Arithmetic is exact (38 digits).

Defined cases: a null or empty text has no words; a null language is ``und``;
rows that repeat an id are rows like any other (ids are not read); ties go to
the more frequent phrase, then to the smaller one in UTF-8 byte order; other
columns are not read; no candidate gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import in_bitmap, key_bitmap, slices, stage, unstage, utf8_list
from feedloom.llm.hashing import joined, mix, runs, span_hashes

LONGEST, LEAST, REPORT = 5, 100, 2000
#: A longer phrase covers a candidate with this many hundredths of its count.
COVER = 100
SLICE_BYTES = 1 << 20
#: The bitmap of frequent hashes has a bit for each of these shifts of a hash,
#: about 32 bits per hash, and 2 ** these at least and at most.
PROBES, FEWEST_BITS, MOST_BITS = (0, 18, 36), 20, 28

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
_FACTORS = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of a few texts: where they stand, and their numbers.  Words
    whose hash is one of ``shared`` (sorted) get another for this ``turn``."""

    def __init__(self, texts: list[bytes], langs: list[str], shared: np.ndarray, turn: int):
        data, begins = joined(texts)
        self.data = _LOWER[data]
        self.starts, self.ends = runs(_WORD[self.data])
        self.piece = np.cumsum(_BREAK[self.data], dtype=np.int32)[self.starts]         # texts end with a break
        names = sorted(set(langs))
        code = {x: i for i, x in enumerate(names)}
        count = np.diff(np.searchsorted(self.starts, begins))
        self.names, self.lang = names, np.repeat([code[x] for x in langs], count).astype(np.int64)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], dtype=np.uint64)
        self.words = span_hashes(self.data, self.starts, self.ends) + (salt[self.lang] if names else np.uint64(0))
        for i in np.flatnonzero(~_absent(self.words, shared)).tolist():
            word = self.data[self.starts[i]:self.ends[i]].tobytes()
            other = hashlib.blake2b(word, digest_size=8, key=turn.to_bytes(4, "little"), salt=salt[self.lang[i]].tobytes())
            self.words[i] = int.from_bytes(other.digest(), "little")

    def counted(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Number, language, spelling and count of the different words."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(self.data[_WORD[self.data]])).dictionary_encode()
        at = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, count = np.unique(self.lang * len(spelled.dictionary) + at, return_index=True, return_counts=True)
        return (self.words[first].view(np.int64), pa.array(self.names, pa.string()).take(pa.array(self.lang[first])),
                spelled.dictionary.take(pa.array(at[first])), count)

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash (int64) of the n words from each word on, and whether they lie
        in one piece."""
        m = max(0, len(self.words) - n + 1)
        return phrase_hashes([self.words[j:j + m] for j in range(n)]), self.piece[:m] == self.piece[n - 1:n - 1 + m]


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hash (int64) of phrases whose first words have the numbers ``words[0]``,
    and so on."""
    h = np.full(len(words[0]), len(words), dtype=np.uint64)
    for j, w in enumerate(words):
        h += w * _FACTORS[j]
    return mix(h).view(np.int64)


def _words(batches, shared: np.ndarray, turn: int):
    for whole in batches:
        for b in slices(whole, 1, SLICE_BYTES):
            yield Words(utf8_list(b.column(1)), b.column(0).to_pylist(), shared, turn)


def _absent(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are not in the sorted ``among``."""
    if not len(among):
        return np.ones(len(keys), dtype=bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] != keys


def counted_words(docs: DataFrame, least: int) -> tuple[DataFrame, np.ndarray, int]:
    """(w1, lang, word, f) of every word, staged, no two of which share the
    number w1 of one that occurs ``least`` times; and what makes the numbers:
    the hashes that would be shared, and the turn."""
    shared = np.zeros(0, dtype=np.uint64)
    for turn in itertools.count():
        def run(batches, shared=shared, turn=turn):
            for w in _words(batches, shared, turn):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in w.counted()], names=["w1", "lang", "word", "c"])

        words = stage(docs.mapInArrow(run, "w1 long, lang string, word string, c long").groupBy("w1", "lang", "word").agg(F.sum("c").alias("f")),
                      "words")
        twice = words.groupBy("w1").agg(F.count("*").alias("k"), F.max("f").alias("f")).where((F.col("k") > 1) & (F.col("f") >= least))
        found = twice.select("w1").toArrow()["w1"].to_numpy().view(np.uint64)
        if not len(found):
            return words, shared, turn
        unstage(words)
        shared = np.union1d(shared, found)


def _columns(n: int) -> list[str]:
    return [f"w{j}" for j in range(1, n + 1)]


def frequent_phrases(docs: DataFrame, n: int, least: int, shorter: DataFrame, shared: np.ndarray, turn: int) -> DataFrame:
    """(w1, w2, ..., f): the phrases of n words, by the numbers of these, that
    occur ``least`` times; ``shorter`` has those of n - 1 words."""
    def hashed(batches):
        for b in batches:
            words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(words))], names=["h"])

    known = docs.sparkSession.sparkContext.broadcast(bitmap(shorter.select(_columns(n - 1)).mapInArrow(hashed, "h long")))

    def run(batches):
        for w in _words(batches, shared, turn):
            h, use = w.phrases(n)
            part = maybe(known.value, w.phrases(n - 1)[0])
            at = np.flatnonzero(use & part[:len(h)] & part[1:1 + len(h)])
            at = at[np.argsort(h[at])]
            words = [w.words[at + j] for j in range(n)]
            new = np.ones(len(at), dtype=bool)      # equal phrases stand together; a row for each run of them
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in words])
            first = np.flatnonzero(new)
            count = np.diff(first, append=len(at))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64)) for x in words), pa.array(count)], names=[*_columns(n), "c"])

    rows = docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*_columns(n), "c"]))
    return rows.groupBy(_columns(n)).agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the hashes, sized by their number within fixed bounds."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (32 * hashes.count()).bit_length()))
    probes = F.explode(F.array(*[F.shiftrightunsigned("h", s) for s in PROBES]))
    return key_bitmap(hashes.select(probes.alias("h")), "h", 1 << bits)


def maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where a hash may be among those of the bitmap (never a false no)."""
    out = in_bitmap(bits, h)
    for s in PROBES[1:]:
        on = np.flatnonzero(out)
        out[on] = in_bitmap(bits, (h[on].view(np.uint64) >> np.uint64(s)).view(np.int64))
    return out


def exact_counts(words: DataFrame, frequent: DataFrame, orders: list[DataFrame]) -> DataFrame:
    """(lang, words, f): the phrases of ``orders``, made of ``frequent`` words and
    spelled, and per language the phrase of no word with f = n."""
    total = words.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.array().cast("array<string>").alias("words"), "f")
    keys = [df.select(F.array(_columns(n)).alias("key"), "f") for n, df in enumerate(orders, 1)]
    keys = functools.reduce(DataFrame.unionByName, keys)
    spelled = (keys.select("key", "f", F.posexplode("key").alias("at", "w1")).join(frequent.select("w1", "lang", "word"), "w1")
               .groupBy("lang", "key", "f").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
               .select("lang", F.col("words.word").alias("words"), "f"))
    return total.unionByName(spelled)


def in_lockstep(stream: DataFrame, key: str, chain: str, extension: str, name: str) -> DataFrame:
    """Add to every row of ``stream`` (lang, f, the array ``key``, others):
    ``chain``, the f of the rows whose key is a beginning of it, by length from
    0; ``extension``, the largest f of a row whose key goes on by one word (0 if
    none).  With a key, all its beginnings must be there."""
    extra = [c for c in stream.columns if c not in ("lang", "f", key)]
    types = {c: stream.schema[c].dataType for c in stream.columns}
    cast = lambda c: f"{c} {types[c].simpleString()}"
    schema = ", ".join(map(cast, ["lang", "f", key, *extra])) + f", {chain} array<long>, {extension} long, part int, late boolean"
    columns = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches):
        part, lang, last = TaskContext.get().partitionId(), None, []
        open_, done, arrow = [], [], None      # open_[d]: row of the key's first d words

        def close(to):
            """Rows that no more rows go on from."""
            while len(open_) > to:
                done.append(open_.pop())

        def out():
            cols = list(zip(*done)) if done else [[] for _ in columns]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow)], names=columns)

        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in columns[:3 + len(extra)]}
            arrow = [get[c].type for c in get] + [pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.bool_()]
            for lang_, f, words, *rest in zip(*(get[c].to_pylist() for c in get)):
                same = 0
                if lang_ == lang:
                    while same < min(len(last), len(words)) and last[same] == words[same]:
                        same += 1
                    close(same + 1)
                else:
                    close(0)
                lang, last = lang_, words
                while len(open_) < len(words):      # begun in the partition before
                    d = len(open_)
                    open_.append([lang, None, words[:d], *[None] * len(rest), [r[1] for r in open_], 0, part, True])
                if open_ and len(words):
                    open_[-1][-3] = max(open_[-1][-3], f)
                open_.append([lang, f, words, *rest, [r[1] for r in open_], 0, part, False])
            yield out()
        close(0)
        if arrow:
            yield out()

    walked = stage(stream.repartitionByRange("lang", key).sortWithinPartitions("lang", key).mapInArrow(run, schema), name)
    # at most one row per partition and length of a key
    late = walked.where("late").select("lang", key, "part", F.col(extension).alias("_more"))
    late = stage(F.broadcast(late).join(stream.select("lang", key, "f"), ["lang", key]), f"{name}-late")
    known = late.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.size(key), "f"))).alias("_known"))
    more = late.groupBy("lang", key).agg(F.max("_more").alias("_more"))
    filled = F.transform(chain, lambda x, i: F.coalesce(x, F.try_element_at("_known", i)))
    return (walked.where("not late").join(F.broadcast(known), "part", "left").join(F.broadcast(more), ["lang", key], "left")
            .select("lang", "f", key, *extra, F.when(F.col("_known").isNull(), F.col(chain)).otherwise(filled).alias(chain),
                    F.greatest(extension, F.coalesce("_more", F.lit(0))).alias(extension)))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, report: int = REPORT, cover: int = COVER,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``report`` phrases of each language: lang, rank, phrase, a, l,
    r, n, score."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, *numbers = counted_words(docs, least)
    frequent = words.where(F.col("f") >= least)
    orders = [frequent.select("w1", "f")]
    for n in range(2, longest + 1):
        orders.append(stage(frequent_phrases(docs, n, least, orders[-1], *numbers), f"phrases-{n}"))
    counts = stage(exact_counts(words, frequent, orders), "phrase-counts")
    unstage(words, *orders[1:])

    forward = in_lockstep(counts, "words", "begin", "right", "phrases-prefix")
    backward = forward.withColumn("back", F.reverse("words"))
    both = in_lockstep(stage(backward, "phrases-forward"), "back", "end", "left", "phrases-suffix")

    big = lambda c: f"cast({c} as decimal(19, 0))"
    at = "size(words)"
    score = f"(1000 * {big('f')} * {big('begin[0]')}) div ({big('begin[k]')} * {big(f'end[{at} - k]')})"
    cut = f"array_min(transform(sequence(1, {at} - 1), k -> struct({score} as score, k as k, begin[k] as l, end[{at} - k] as r)))"
    scored = (both.where(F.size("words") > 1).where(F.greatest("left", "right") * 100 < F.lit(cover) * F.col("f"))
              .select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.expr("begin[0]").alias("n"), F.expr(cut).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    # the report of a language is taken from those of its parts, so none is sorted by one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", first("part")).where(F.col("rank") <= report)
    return (some.withColumn("rank", first()).where(F.col("rank") <= report)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
