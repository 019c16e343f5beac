"""Quality rules and perplexity bands of an n-gram model counted by Spark.

The model is a modified Kneser-Ney model of the characters of texts, one for
each language: the symbols are each word's characters and its end.  A word's
first symbol is told from the last four symbols before it, across the blank, so
the order of words counts; the others have contexts that go back to the word's
start at most.  So a text is a bag of words and of junctions (the three symbols
before a word's end, the end, and the next word's first symbol), of which there
are far fewer than pairs of words.  Spark counts the words and junctions of all
documents and from them the n-grams, their continuations, discounts and
probabilities.  Probabilities and back-off weights are stored in arrays sorted
by the n-grams' hashes, which scoring searches.  A document's perplexity must
lie in its language's band, which comes from the quartiles over all documents
that pass the base rules.

The arrays are broadcast only if they have at most ``MOST_BROADCAST`` entries
(16 bytes each).  A larger model scores the distinct words and junctions by
joins, and the documents by joining theirs; the results are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.llm.common import WORD, cut, text_or_empty

ORDER = 5
#: No word holds either.  A text begins with three starts and the end of no word.
START, END = "\n", " "
BEFORE = START * 3 + END
#: The junctions of a text of words with one blank between: at each blank, what lies around it.
#: Java looks back by code points only if the pattern holds one beyond 16 bits, here in the class of all.
JUNCTION = f"{END}[^{END}](?<=([\\s\\S\U00010000]{{3}}{END}[^{END}]))"
MOST_BROADCAST = 6_000_000
#: Half-widths of the bands in quartile distances of the log perplexity, and the least distance.
BELOW, ABOVE, LEAST_SPREAD = 3.0, 3.0, 0.02
#: Quartiles are read from counts by steps of the log perplexity: exact to a step, however the rows are spread.
STEPS = 4096
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
CACHED, BATCH_CHARS = 300_000, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


# --- hashes of n-grams ---------------------------------------------------------------------


def _mixed(polynomials: np.ndarray, length: int) -> np.ndarray:
    h = (polynomials + np.uint64(length)) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def gram_hashes(grams: list[str]) -> np.ndarray:
    """64-bit hashes of strings of up to ``ORDER`` characters."""
    out = np.zeros(len(grams), np.uint64)
    lengths = np.array([len(g) for g in grams], np.int64)
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        if n:
            codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
            out[at] = _mixed(h, n)
    return out


@F.pandas_udf(T.LongType())
def _hashed(grams: pd.Series) -> pd.Series:
    return pd.Series(gram_hashes(grams.tolist()).view(np.int64))


# --- the model -----------------------------------------------------------------------------


def tokens(rows: DataFrame, *columns: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(columns, lang, token): the words and the junctions of each whole text, repeats included."""
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0))
    found = rows.select(*columns, text_or_empty(F.col(lang_col)).alias("lang"), words.alias("words"))
    junctions = F.regexp_extract_all(F.concat(F.lit(BEFORE), F.array_join("words", END)), F.lit(JUNCTION), F.lit(1))
    return found.select(*columns, "lang", F.explode(F.concat("words", junctions)).alias("token"))


def token_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, token, n) over the whole texts of all rows; a null language is the language ''."""
    return tokens(docs, text_col=text_col, lang_col=lang_col).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


def _framed(counted: DataFrame, *columns: str) -> DataFrame:
    """(columns, s, first): the symbols of each token, and the place (from 1) of the first that it tells.

    A word tells its symbols after the first, a junction its last.
    """
    across = F.contains(F.col("token"), F.lit(END))
    s = F.when(across, F.col("token")).otherwise(F.concat(F.lit(START), F.col("token"), F.lit(END)))
    return counted.select(*columns, s.alias("s"), F.when(across, F.length("token")).otherwise(F.lit(3)).alias("first"))


def gram_counts(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): raw counts of the longest n-grams and of those that begin with a start, else continuations.

    A continuation count is the number of different symbols seen in front.
    """
    framed = _framed(counted, "lang", "n")
    ends = F.transform(F.sequence("first", F.length("s")), lambda e: F.substr(F.col("s"), F.greatest(e - (order - 1), F.lit(1)), F.least(e, F.lit(order))))
    longest = framed.select("lang", F.explode(ends).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tails = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.substr(F.col("gram"), i))
    kinds = cut(longest.select("lang", F.explode(tails).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("c")), "grams")
    raw = kinds.where(F.startswith("gram", F.lit(START)) | (F.length("gram") == order))
    continued = kinds.groupBy("lang", F.substr("gram", F.lit(2)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    return raw.unionByName(continued.where(~F.startswith("gram", F.lit(START))))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, k, d1, d2, d3) from how many n-grams of length k have counts 1 to 4; half of i where that gives none."""
    of = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    seen = counts.groupBy("lang", "k").agg(*of)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        d = F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when((d > 0) & (d <= i), d).otherwise(F.lit(0.5 * i)).alias(f"d{i}")

    return seen.select("lang", "k", *(discount(i) for i in (1, 2, 3)))


def probabilities(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, logp), and (lang, context, backoff) with the empty context's for symbols never seen."""
    counts = counts.withColumn("k", F.length("gram"))
    counts = counts.join(cut(_discounts(counts), "discounts"), ["lang", "k"])
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    counts = cut(counts.select("lang", "k", "gram", F.substr("gram", F.lit(1), F.col("k") - 1).alias("context"), F.col("c").cast("double").alias("c"), taken.alias("d")), "discounted")
    contexts = counts.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(F.least("c", "d")).alias("left"), F.count(F.lit(1)).alias("kinds"))
    weight = F.col("left") / F.col("total")
    empty = F.length("context") == 0
    contexts = cut(contexts.select("lang", "context", "total", F.when(empty, weight / (F.col("kinds") + 1)).otherwise(weight).alias("weight")), "contexts")
    levels, below = [], None
    for k in range(1, order + 1):
        level = counts.where(F.col("k") == k).join(contexts, ["lang", "context"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if below is None:
            level = level.select("lang", "gram", (own + F.col("weight")).alias("p"))
        else:
            level = level.withColumn("tail", F.substr("gram", F.lit(2))).join(below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
            level = level.select("lang", "gram", (own + F.col("weight") * F.col("lower")).alias("p"))
        below = cut(level, f"level{k}")
        levels.append(below)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    return grams.select("lang", "gram", F.log("p").alias("logp")), contexts.select("lang", "context", F.log("weight").alias("backoff"))


@dataclass
class Arrays:
    """One language's model: hashes in order, and their values; the log probability of unknown symbols."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    unknown: float

    def score(self, tokens: list[str], order: int = ORDER) -> np.ndarray:
        """The log probability of what each token tells: a word's symbols after its first, a junction's last."""
        across = np.array([END in t for t in tokens], bool)
        framed = [t if a else START + t + END for t, a in zip(tokens, across, strict=True)]
        codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        lengths = np.array([len(t) for t in framed], np.int64)
        first = np.repeat(lengths.cumsum() - lengths, lengths)
        depth = np.arange(len(codes)) - first
        hashes, h, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
        for n in range(order):  # of the n + 1 characters that end here
            h[n:] += codes[: len(codes) - n] * power
            power = np.uint64(int(power) * int(_BASE) % (1 << 64))
            hashes.append(_mixed(h, n + 1))
        out, carried = np.zeros(len(codes)), np.zeros(len(codes))
        open_ = np.flatnonzero(depth >= np.repeat(np.where(across, lengths - 1, 2), lengths))
        for n in range(order, 0, -1):
            fits = depth[open_] >= n - 1
            at = open_[fits]
            place, found = _search(self.grams, hashes[n - 1][at])
            out[at[found]] = carried[at[found]] + self.logp[place[found]]
            missed = at[~found]
            if n > 1:
                place, known = _search(self.contexts, hashes[n - 2][missed - 1])
                carried[missed[known]] += self.backoff[place[known]]
            open_ = np.sort(np.concatenate([open_[~fits], missed]))
        out[open_] = carried[open_] + self.unknown
        return np.add.reduceat(out, lengths.cumsum() - lengths) if len(tokens) else np.zeros(0)


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    different, which = np.unique(wanted, return_inverse=True)  # few, and in order: the search stays in the cache
    place = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
    return place[which], (keys[place] == different)[which]


def arrays(grams: DataFrame, contexts: DataFrame) -> dict[str, Arrays]:
    """The sorted hash arrays by language, on the driver; the caller has checked their size."""
    held = grams.select("lang", _hashed("gram").alias("key"), F.col("logp").alias("value")).toArrow()
    back = contexts.where("context <> ''").select("lang", _hashed("context").alias("key"), F.col("backoff").alias("value")).toArrow()
    unknown = {r["lang"]: r["backoff"] for r in contexts.where("context = ''").collect()}

    def in_order(rows: pa.Table, lang: str) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.filter(pc.equal(rows["lang"], lang))
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], rows["value"].to_numpy()[order]

    return {lang: Arrays(*in_order(held, lang), *in_order(back, lang), value) for lang, value in unknown.items()}


def token_scores(counted: DataFrame, grams: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, token, logp) by joins: what ``Arrays.score`` gives, for a model of any size."""
    framed = _framed(counted, "lang", "token")
    tries = F.flatten(F.transform(F.sequence("first", F.length("s")), lambda e: F.transform(
        F.sequence(F.lit(1), F.least(e, F.lit(order))), lambda n: F.struct(e.alias("e"), n.alias("n"), F.substr(F.col("s"), e - n + 1, n).alias("gram")))))
    tried = framed.select("lang", "token", F.inline(tries))
    tried = tried.withColumn("context", F.substr("gram", F.lit(1), F.col("n") - 1))
    tried = tried.join(grams, ["lang", "gram"], "left").join(contexts, ["lang", "context"], "left")
    best = F.max(F.when(F.col("logp").isNotNull(), F.struct("n", "logp")))
    backs = F.collect_list(F.when(F.col("logp").isNull(), F.struct("n", F.coalesce("backoff", F.lit(0.0)).alias("b"))))
    at = tried.groupBy("lang", "token", "e").agg(best.alias("best"), backs.alias("backs"))  # at most ``order`` rows each
    above = F.filter("backs", lambda b: b["n"] > F.coalesce(F.col("best.n"), F.lit(0)))
    at = at.withColumn("logp", F.coalesce("best.logp", F.lit(0.0)) + F.aggregate(above, F.lit(0.0), lambda x, b: x + b["b"]))
    return at.groupBy("lang", "token").agg(F.sum("logp").alias("logp"))


# --- documents -----------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five words that the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(map(b" ".join, zip(*(words[i:] for i in range(WINDOW)), strict=False)))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


_BASES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _with_counts(docs: DataFrame, model) -> DataFrame:
    """(id, lang, base counts, logp): ``model`` is a broadcast of arrays, or None for a null logp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, bytes], float] = {}
        for batch in batches:
            texts, langs = [t or "" for t in batch["text"]], batch["lang"].tolist()
            sizes = np.cumsum([len(t) for t in texts]) // BATCH_CHARS
            logp = []
            bases = []
            for part in np.unique(sizes):
                chosen = np.flatnonzero(sizes == part)
                words = [texts[i].encode().split() for i in chosen]
                bases += [base_counts(texts[i], w) for i, w in zip(chosen, words, strict=True)]
                if model is not None:
                    logp += _log_probabilities(words, [langs[i] for i in chosen], model.value, known)
            out = pd.DataFrame(bases, columns=[c.split()[0] for c in _BASES.split(", ")])
            out.insert(0, "id", batch["id"].reset_index(drop=True))
            out.insert(1, "lang", langs)
            out["logp"] = logp if model is not None else None
            yield out

    rows = docs.select("id", F.col("text").cast("string").alias("text"), text_or_empty(F.col("lang")).alias("lang"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, {_BASES}, logp double")


def junctions(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The junctions of some texts: five code points each, and the number of the text it is in."""
    streams = [BEFORE + b" ".join(w).decode() for w in words]
    codes = np.frombuffer("".join(streams).encode("utf-32-le"), "<u4")
    at = np.flatnonzero(codes[:-1] == ord(END)) + 1
    at = at[codes[at] != ord(START)]  # behind a text without a word the next one begins
    ends = np.cumsum([len(s) for s in streams])
    return codes[at[:, None] + np.arange(-4, 1)], np.searchsorted(ends, at, side="right")


def _across(words: list[list[bytes]], model: Arrays) -> np.ndarray:
    """For each text the log probability of the first symbols of its words."""
    found, text = junctions(words)
    if not len(found):
        return np.zeros(len(words))
    h = np.zeros(len(found), np.uint64)
    for k in range(found.shape[1]):
        h = h * _BASE + found[:, k].astype(np.uint64) + np.uint64(1)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    scores = model.score([row.tobytes().decode("utf-32-le") for row in found[one]])
    return np.bincount(text, weights=scores[which], minlength=len(words))


def _log_probabilities(words: list[list[bytes]], langs: list[str], models: dict[str, Arrays], known: dict) -> list[float]:
    out = [0.0] * len(words)
    for lang in set(langs):
        at = [i for i, x in enumerate(langs) if x == lang]
        of_lang = known.setdefault(lang, {})
        needed = set().union(*(words[i] for i in at))
        new = list(needed.difference(of_lang))
        if len(of_lang) + len(new) > CACHED:  # what the batch needs stays
            kept = {w: of_lang[w] for w in needed.difference(new)}
            of_lang.clear()
            of_lang.update(kept)
        scores = models[lang].score([w.decode() for w in new]) if new else []
        of_lang.update(zip(new, np.asarray(scores).tolist(), strict=True))
        across = _across([words[i] for i in at], models[lang]) if needed else np.zeros(len(at))
        for i, first in zip(at, across.tolist(), strict=True):
            out[i] = sum(map(of_lang.__getitem__, words[i])) + first
    return out


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, log_perplexity, the band's ends, kept.

    ``log_perplexity`` is the negative log probability per symbol, null without
    a word.  Null, empty and blank texts have no words and fail the base rules.
    A null language is a language of its own.  A language without any document
    that passes the base rules has no band, and it has no document to judge.
    Repeated rows count and stay; other columns are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = cut(token_counts(rows), "tokens")
    counts = cut(gram_counts(counted), "counts")
    grams, contexts = probabilities(counts)
    if counts.count() <= most_broadcast:
        scored = cut(_with_counts(rows, docs.sparkSession.sparkContext.broadcast(arrays(grams, contexts))), "scored")
    else:
        numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        of_token = cut(token_scores(counted, grams, contexts), "token_scores")
        each = tokens(numbered, "row").groupBy("row", "lang", "token").agg(F.count(F.lit(1)).alias("n"))
        sums = each.join(of_token, ["lang", "token"]).groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("logp"))
        based = _with_counts(numbered.select(F.struct("row", "id").alias("id"), "text", "lang"), None).drop("logp")
        scored = based.join(sums, F.col("id.row") == F.col("row"), "left").withColumn("id", F.col("id.id"))
        scored = cut(scored.select("id", "lang", *(c.split()[0] for c in _BASES.split(", ")), "logp"), "scored")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    per_symbol = F.try_divide(-F.col("logp"), F.col("word_chars") + F.col("n_words"))
    scored = scored.withColumns({"base_failed": failed, "log_perplexity": per_symbol})
    # At most a row for each language and step.
    steps = scored.where(~F.col("base_failed")).groupBy(F.col("lang").alias("of_lang"), F.floor(F.col("log_perplexity") * STEPS).alias("step"))
    steps = cut(steps.agg(F.count(F.lit(1)).alias("n")), "steps")
    of_lang = Window.partitionBy("of_lang")
    steps = steps.withColumns({"upto": F.sum("n").over(of_lang.orderBy("step")), "all": F.sum("n").over(of_lang)})
    low, high = (F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("step"))) / STEPS for q in (1, 3))
    bands = steps.groupBy("of_lang").agg(low.alias("q1"), high.alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    bands = bands.select("of_lang", (F.col("q1") - BELOW * spread).alias("band_low"), (F.col("q3") + ABOVE * spread).alias("band_high"))
    # A row for each language: as a table of known size Spark broadcasts it, and no language meets in one task.
    judged = scored.join(cut(bands, "bands"), F.col("lang") == F.col("of_lang"), "left")
    within = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return judged.select(F.col("id").alias(id_col), *(c.split()[0] for c in _BASES.split(", ")), "base_failed", (~F.col("base_failed") & within).alias("kept"), "log_perplexity", "band_low", "band_high")
