"""Collocations: frequent phrases by language, from generalised suffix automata of word sequences.

Each shard of texts gets an automaton of its pieces, bounded in depth: a state is a distinct phrase of at most `depth`
words, with its count of end positions, its suffix link (the phrase without its first word) and the state it is reached
from (the phrase without its last word). As flat arrays, level by level, since a phrase of k words is a state of k - 1
words and one transition. Its counts are added up over all shards.

A phrase is at most as frequent as its parts, so there are passes: words; pairs of frequent words; longer phrases all of
whose pairs are frequent; and at last the phrases that may be frequent, spelled out. The middle passes count by hash and
only say what may be frequent: the shards get a bit array, of at most 2^28 bits however large the corpus, whose false hits
cost rows, while counts of the phrases themselves decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import give_back, lowered, mix, range_hashes, texts_of, words_of
from .common import heavy_join, only, text_batches, written
from .files import table

#: Bytes of text in one shard's automaton (or one piece, if that is longer).
SHARD_BYTES = 1 << 22
#: Bits of a filter for each frequent phrase, and the most of them all.
BITS_EACH, MOST_BITS = 16, 1 << 28
LONGEST = 4
#: Rows of one batch that a shard hands on.
ROWS = 1 << 15
_U = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_LETTER = ~_ENDS
_LETTER[[9, 32]] = False


class Automaton:
    """The suffix automaton of word sequences, in phrases of at most `depth` words.

    size, word, prefix, link and count, by state: words of the phrase, its last word, the state without that word, the
    state without the first word (-1 for single words), and its end positions. level[k] is the first state of k + 1 words.
    """

    def __init__(self, words: np.ndarray, joined: np.ndarray, depth: int):
        """words: numbers from 0; joined: whether each follows the one before it in its sequence, false for the first."""
        kinds, at = np.unique(words, return_inverse=True)
        none = np.full(len(kinds), -1)
        parts = [(np.ones(len(kinds), np.int8), kinds, none, none, np.bincount(at, minlength=len(kinds)))]
        self.level, ending = [0, len(kinds)], at.astype(np.int64)  # ending: the state of the phrase that ends at each place
        for k in range(2, depth + 1):
            place = np.flatnonzero(joined)
            place = place[ending[place - 1] >= 0]
            prefix, suffix = ending[place - 1], ending[place]
            _, first, state, count = np.unique(prefix * (len(kinds) + 1) + at[place], return_index=True, return_inverse=True, return_counts=True)
            parts.append((np.full(len(first), k, np.int8), kinds[at[place[first]]], prefix[first], suffix[first], count))
            ending = np.full(len(words), -1)
            ending[place] = state + self.level[-1]
            self.level.append(self.level[-1] + len(first))
        self.size, self.word, self.prefix, self.link, self.count = (np.concatenate(x) for x in zip(*parts, strict=True))

    def keys(self, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A hash of each state's phrase, from those of the single words' states and of words; words are numbers of own, modulo their number."""
        out = np.zeros(len(self.size), _U)
        out[: self.level[1]] = first
        for lo, hi in zip(self.level[1:-1], self.level[2:], strict=True):
            out[lo:hi] = _joined_hash(out[self.prefix[lo:hi]], own[self.word[lo:hi] % len(own)])
        return out

    def phrases(self, names: pa.Array):
        """The phrase of each state, by level; words are numbers of names, modulo their number."""
        text = None
        for k in range(1, len(self.level)):
            lo, hi = self.level[k - 1], self.level[k]
            last = names.take(pa.array(self.word[lo:hi] % len(names)))
            text = last if k == 1 else pc.binary_join_element_wise(text.take(pa.array(self.prefix[lo:hi] - self.level[k - 2])), last, pa.scalar(b" ", last.type))
            yield text


def _hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary column without nulls."""
    names = names.cast(pa.large_binary())
    _, off, data = names.buffers()
    off = np.frombuffer(off, np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    return range_hashes(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), off[:-1], off[1:])


def _joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U(0x9E3779B97F4A7C15) + right)


class Filter:
    """A bit array of hashes: `has` never says no to a member."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & _U(len(self.bits) * 32 - 1)
        return (self.bits[(slot >> _U(5)).astype(np.int64)] >> (slot & _U(31)).astype(np.uint32)) & np.uint32(1) == 1


def _word_keys(batches):
    """Arrow function (lang, phrase), phrases of one word -> (key)."""
    for batch in batches:
        lang, word = (c.cast(pa.large_binary()) for c in batch.columns)
        yield table({"key": pa.array(_joined_hash(_hashes(lang), _hashes(word)).view(np.int64))})


def _filter(keys: DataFrame) -> Filter:
    """keys(key) of frequent phrases -> their filter. The driver gets at most a place of 8 bytes for each 32 bits, or for each key if those are fewer."""
    n = keys.count()
    n_bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * n - 1).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(n_bits - 1))
    places = keys.select(F.shiftright(slot, 5).alias("place"), F.expr("shiftleft(1L, cast(key & 31 as int))").alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 32, np.uint32)
    bits[places.column("place").to_numpy()] = places.column("bits").to_numpy().astype(np.uint32)
    return Filter(bits)


def _shards(batches):
    """(languages, bytes, offsets) of batches' texts, in parts of some SHARD_BYTES; long texts are cut between pieces, a part being a text then."""
    for batch in batches:
        buf, off = texts_of(batch.column(1))
        cuts = []
        for i in np.flatnonzero(np.diff(off) > SHARD_BYTES):
            ends = np.flatnonzero(_ENDS[buf[off[i] : off[i + 1]]]) + 1
            at = np.searchsorted(ends, np.arange(SHARD_BYTES, off[i + 1] - off[i], SHARD_BYTES), "right") - 1
            cuts.append(np.unique(ends[at[at >= 0]]) + off[i])
        bounds = np.unique(np.concatenate([off, *cuts]))
        of = np.searchsorted(off, bounds[:-1], "right") - 1
        lo = 0
        while lo < len(of):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SHARD_BYTES, "right")) - 1)
            yield batch.column(0).take(pa.array(of[lo:hi])), buf[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            lo = hi
        give_back()


def _counted(lengths: tuple[int, ...], filters: tuple = (), spelled: bool = True):
    """Arrow function (lang, text) -> of each shard the phrases of these lengths that may be frequent, (lang, phrase, n), or by hash, (key, n).

    filters: of words, of pairs, of longer phrases, as far as they are known.
    """

    def run(batches):
        for langs, buf, off in _shards(batches):
            buf = lowered(buf)
            start, end, doc = words_of(buf, off, _LETTER)
            if not len(start):
                continue
            piece = np.cumsum(_ENDS[buf], dtype=np.int64)[start]
            joined = np.r_[False, (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])]
            # the words themselves, every second stretch between bounds, so that equal means equal bytes
            bounds = np.stack([start, end], axis=1).reshape(-1)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(buf)])
            words = words.take(pa.array(np.arange(0, len(words), 2))).dictionary_encode()
            langs = langs.cast(pa.large_binary()).dictionary_encode()
            names, word = words.dictionary, words.indices.to_numpy().astype(np.int64)
            lang = langs.indices.to_numpy().astype(np.int64)[doc]
            del start, end, piece, bounds, buf
            own, of = _hashes(names), _hashes(langs.dictionary)
            if filters:
                keys = _joined_hash(of[lang], own[word])
                ok = filters[0].value.has(keys)
                joined &= ok & np.r_[False, ok[:-1]]
                if len(filters) > 1:
                    joined[1:] &= filters[1].value.has(_joined_hash(keys[:-1], own[word[1:]]))
                # the places that stand in a phrase of the least length
                need, keep = joined.copy(), np.zeros(len(joined), bool)
                for _ in range(min(lengths) - 2):
                    need &= np.r_[False, need[:-1]]
                for back in range(min(min(lengths), len(need))):
                    keep[: len(need) - back] |= need[back:]
                at = np.flatnonzero(keep)
                word, lang, joined = word[at], lang[at], joined[at] & (np.diff(at, prepend=-2) == 1)
                if not len(word):
                    continue
            a = Automaton(lang * len(names) + word, joined, max(lengths))
            first = slice(0, a.level[1])
            keys = a.keys(_joined_hash(of[a.word[first] // len(names)], own[a.word[first] % len(names)]), own) if filters else None
            for k, text in enumerate(a.phrases(names) if spelled else [None] * max(lengths), 1):
                states = np.arange(a.level[k - 1], a.level[k])
                if k not in lengths:
                    continue
                if len(filters) > 2 and k > 2:
                    states = states[filters[2].value.has(keys[states])]
                for lo in range(0, len(states), ROWS):
                    some = states[lo : lo + ROWS]
                    n = pa.array(a.count[some])
                    if spelled:
                        row = {"lang": langs.dictionary.take(pa.array(a.word[some] // len(names))), "phrase": text.take(pa.array(some - a.level[k - 1]))}
                        yield table({c: x.view(pa.large_string()).cast(pa.string()) for c, x in row.items()} | {"n": n})
                    else:
                        yield table({"key": pa.array(keys[some].view(np.int64)), "n": n})
            del a, words, names, keys

    return run


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text) -> (lang, n), all words of each language; (lang, phrase, n), phrases of 1 to 4 words that occur at
    least so often, written. Counts are exact.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = only(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")

    def counts(lengths: tuple[int, ...], filters: list[Filter], spelled: bool = True) -> DataFrame:
        by = ["lang", "phrase"] if spelled else ["key"]
        found = docs.mapInArrow(_counted(lengths, tuple(map(spark.sparkContext.broadcast, filters)), spelled), "lang string, phrase string, n long" if spelled else "key long, n long")
        return found.groupBy(*by).agg(F.sum("n").alias("n"))

    def may_be(lengths: tuple[int, ...], filters: list[Filter]) -> Filter:
        return _filter(written(counts(lengths, filters, spelled=False).where(F.col("n") >= least).select("key"), "keys"))

    words = written(counts((1,), []), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    filters = [_filter(frequent.select("lang", "phrase").mapInArrow(_word_keys, "key long"))]
    filters.append(may_be((2,), filters))
    filters.append(may_be((3, 4), filters))
    phrases = written(counts((2, 3, 4), filters).where(F.col("n") >= least), "phrases")
    return sizes, frequent.unionByName(phrases)


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """counts(lang, phrase, n) -> (lang, phrase, a, l, r, score) of the phrases of 2 to 4 words that no longer phrase subsumes.

    The score is 2000000 a / (l + r), floored, of the cut where it is least (ties: the first). A phrase is subsumed if some
    longer one around it has at least 0.8 of its count; phrases one word longer tell, as counts only fall with length. They
    are met over suffix links and prefixes.
    """
    phrase = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    size = F.size("words")
    joined = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    longer = phrase.where(size > 2).select("lang", F.explode(F.array(joined(F.lit(2), size - 1), joined(F.lit(1), size - 1))).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = phrase.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (_exact(F.col("around")) * 100 < _exact(F.col("n")) * 80))
    kept = written(kept.select("lang", "phrase", "words", F.col("n").alias("a")), "kept")

    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")
    sides = F.array(F.struct(F.lit("l").alias("side"), joined(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), joined(F.col("cut") + 1, size - F.col("cut")).alias("part")))
    parts = kept.select("lang", "phrase", "words", "a", cut).select("lang", "phrase", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "a", "cut", "s.side", F.struct("lang", F.col("s.part").alias("phrase")).alias("part"))
    met = heavy_join(parts, counts.select(F.struct("lang", "phrase").alias("part"), F.col("n").alias("m")), "part", "phrase")
    at = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("cut") == k), F.col("m"))).alias(f"{side}{k}")
    wide = met.groupBy("lang", "phrase", "a").agg(*[at(s, k) for s in "lr" for k in range(1, LONGEST)])
    score = lambda k: F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cuts = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)])
    return wide.select("lang", "phrase", "a", F.array_min(cuts).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def best_phrases(scores: DataFrame, most: int = 2000, salts: int = 64) -> DataFrame:
    """The best of each language, with rank: by score, then count, then the phrase's bytes. First by parts of a language, so none is sorted whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scores.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= most)
    ranks = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranks.where(F.col("rank") <= most).drop("_salt")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Words are runs without blanks and tabs in the pieces between . , ; : ! ? and line ends, A-Z lower-cased; a null
    language is `und`. Null, empty and wordless texts have no words. Repeated rows count each; texts are whole, however
    long; without words there is no row. Other columns are ignored.
    """
    sizes, counts = phrase_counts(docs, least)
    best = best_phrases(scored(counts), most)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
     g AS (SELECT lang, m, array_to_string(w[j:j + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM w, range(1, 5) r(m) WHERE len(w) >= m)),
     f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
     n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
     c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
     s AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c o ON o.lang = c.lang AND o.m > c.m AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.a::HUGEINT >= 80 * c.a::HUGEINT),
     k AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c ANTI JOIN s ON s.lang = c.lang AND s.phrase = c.phrase),
     x AS (SELECT k.lang, k.phrase, k.a, k, l.n AS l, r.n AS r, ((2000000 * k.a::HUGEINT) // (l.n + r.n)::HUGEINT)::BIGINT AS score
           FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp),
     b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
