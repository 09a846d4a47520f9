"""Language identification with spans of mixed-language text.

Words are cut where their script changes, and in scripts without spaces at
marks and every few letters.  Training counts hashed character n-grams of all
training texts by language.  Prediction scores each distinct piece once: the script of its letters narrows
the languages to those that use it, and its n-grams give a log-likelihood for
each.  A Viterbi pass over the words of a text, with a penalty for each change
of language, labels them all; runs of one label are the spans, and the
language with most letters is the text's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, opened, shipped, slices, small_batches, tidy, words_of

#: Hash buckets of n-grams; a model has BUCKETS x languages numbers, however much text there is.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Distinct words whose n-grams are held at once.
WORDS_AT_ONCE = 16_384
#: Languages a model may have.
MOST_LANGUAGES = 512
#: Log-likelihood that a change of language costs.
SWITCH = 8.0
#: What a word at most says for one language against another.
MOST_EVIDENCE = 12.0
#: Share of a language's letters from which it is said to use a script.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
#: First code points of ranges, and their scripts.
SCRIPT_RANGES = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x32000, "Other"))
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))
#: Scripts that are written without spaces, and how many of their letters make a piece.
UNSPACED, PIECE_LETTERS = ("Han", "Kana", "Thai"), 4
#: Words that have letters beyond those of Europe's Latin may hold several scripts.
BEYOND_LATIN = "[\u0370-\u1dff\u1f00-\U0010ffff]"
_CACHE: dict = {}


def letters() -> np.ndarray:
    """Which code points are letters."""
    if "letters" not in _CACHE:
        _CACHE["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _CACHE["letters"]


def words_as_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased words, and where each starts.  Characters that aren't letters are left out."""
    lowered = pc.utf8_lower(words.cast(pa.large_string()))
    text = "\n".join(lowered.to_pylist()) + "\n" if len(words) else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 10
    kept = letters()[points]
    word = np.cumsum(ends) - ends
    points, word = points[kept], word[kept]
    return points, np.searchsorted(word, np.arange(len(words) + 1))


def cut(word: str) -> list[str]:
    """The pieces of a word: runs of one script, Han and Kana together; short ones of scripts without spaces."""
    found, group, n, begin = [], None, 0, 0
    for k, c in enumerate(word):
        if not c.isalpha():
            if n and group in UNSPACED:
                found.append(word[begin:k])
                group, n, begin = None, 0, k
            continue
        script = SCRIPTS[scripts_of(np.array([ord(c)]))[0]] if c not in _CACHE else _CACHE[c]
        _CACHE[c] = script
        own = "Han" if script == "Kana" else script
        if group is not None and (own != group or (group in UNSPACED and n == PIECE_LETTERS)):
            found.append(word[begin:k])
            n, begin = 0, k
        group, n = own, n + 1
    return [*found, word[begin:]]


def pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all words, end to end, and where each word's start."""
    words = words.cast(pa.large_string())
    several = np.asarray(pc.match_substring_regex(words, BEYOND_LATIN)) if len(words) else np.zeros(0, bool)
    if not several.any():
        return words, np.arange(len(words) + 1)
    parts = [cut(w) if s else [w] for w, s in zip(words.to_pylist(), several.tolist(), strict=True)]
    return pa.array([p for own in parts for p in own], pa.large_string()), np.concatenate(([0], np.cumsum([len(own) for own in parts])))


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of all texts, the codes of their pieces end to end, and where each text's start."""
    words, at = words_of(texts)
    found = words.dictionary_encode()
    codes = np.asarray(found.indices, dtype=np.int64)
    distinct, start = pieces(found.dictionary)
    if len(distinct) == len(found.dictionary):
        return distinct, codes, at
    again = distinct.dictionary_encode()
    own = np.asarray(again.indices, dtype=np.int64)
    times = np.diff(start)[codes]
    ends = np.concatenate(([0], np.cumsum(times)))
    place = np.repeat(start[:-1][codes] - ends[:-1], times) + np.arange(ends[-1])
    return again.dictionary, own[place], ends[at]


def gram_buckets(points: np.ndarray, start: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """bucket and word of each n-gram of each word, with an edge mark at both ends."""
    n = np.diff(start)
    have = np.flatnonzero(n)
    size = n[have] + 2
    begin = np.concatenate(([0], np.cumsum(size)))
    marked = np.full(begin[-1], 1, np.uint64)
    inner = np.ones(begin[-1], bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    marked[inner] = points
    word = np.repeat(have, size)
    found_bucket, found_word = [], []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            stop = max(0, len(marked) - order + 1)
            whole = word[:stop] == word[order - 1 : order - 1 + stop]
            if order == 1:
                whole = whole & inner
            h = np.full(stop, order * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
            for k in range(order):
                h = (h ^ marked[k : k + stop]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
            found_bucket.append((h[whole] % np.uint64(buckets)).astype(np.int64))
            found_word.append(word[:stop][whole])
    return np.concatenate(found_bucket), np.concatenate(found_word)


def scripts_of(points: np.ndarray) -> np.ndarray:
    ranges = np.array([a for a, _ in SCRIPT_RANGES])
    of = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])
    return of[np.searchsorted(ranges, points, side="right") - 1]


def _counts(buckets: int):
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            distinct, codes, at = pieces_of(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            of_word = np.repeat(np.asarray(lang.indices, dtype=np.int64), np.diff(at))
            names = lang.dictionary.to_pylist()
            times = [np.bincount(codes[of_word == k], minlength=len(distinct)).astype(np.float64) for k in range(len(names))]
            for low in range(0, len(distinct), WORDS_AT_ONCE):
                points, start = words_as_points(distinct.slice(low, WORDS_AT_ONCE))
                gram, owner = gram_buckets(points, start, buckets)
                script, letter_word = scripts_of(points), np.repeat(np.arange(len(start) - 1), np.diff(start))
                for name, all_times in zip(names, times, strict=True):
                    n = all_times[low : low + WORDS_AT_ONCE]
                    if name not in totals:
                        totals[name] = np.zeros(buckets + len(SCRIPTS))
                    totals[name][:buckets] += np.bincount(gram, n[owner], minlength=buckets)
                    totals[name][buckets:] += np.bincount(script, n[letter_word], minlength=len(SCRIPTS))
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])

    return count


class LanguageModel:
    """names, a (buckets + 1) x languages table of log-likelihoods, and which scripts each language uses."""

    def __init__(self, counts: pd.DataFrame, buckets: int = BUCKETS):
        self.buckets = buckets
        self.names = sorted(counts["lang"].unique())
        if len(self.names) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.names)} languages; a model may have {MOST_LANGUAGES}")
        table = np.zeros((buckets + len(SCRIPTS), max(1, len(self.names))))
        for k, name in enumerate(self.names):
            own = counts[counts["lang"] == name]
            table[own["bucket"], k] = own["n"]
        grams, scripts = table[:buckets], table[buckets:]
        self.log = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * buckets)).astype(np.float32)
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)

    def word_scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """words x languages, and the letters of each word."""
        parts = [self._word_scores(words.slice(low, WORDS_AT_ONCE)) for low in range(0, max(1, len(words)), WORDS_AT_ONCE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _word_scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, start = words_as_points(words)
        gram, owner = gram_buckets(points, start, self.buckets)
        n = np.diff(start)
        out = np.zeros((len(words), len(self.names)), np.float32)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, self.log[gram, k], minlength=len(words))
        # n-grams of one word overlap: the mean of the orders counts
        out /= len(ORDERS)
        out -= out.max(1, keepdims=True, initial=-np.inf)
        out = np.maximum(out, -MOST_EVIDENCE)
        # a piece's script narrows the languages, if any of them uses it; with Kana in it, it is Kana
        have = np.flatnonzero(n)
        script = scripts_of(points[start[:-1][have]])
        kana = np.flatnonzero(scripts_of(points) == SCRIPTS.index("Kana"))
        script[np.isin(have, np.searchsorted(start, kana, side="right") - 1)] = SCRIPTS.index("Kana")
        allowed = self.uses[script]
        allowed[~allowed.any(1)] = True
        out[have] = np.where(allowed, out[have], -4 * MOST_EVIDENCE)
        out[n == 0] = 0
        return out, n

    def label(self, scores: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The language of each word: Viterbi over all texts, a word of each at a time."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], at[:-1][order]
        live = int((size > 0).sum())
        label = np.zeros(len(codes), np.int64)
        if not live:
            return label
        # steps are held place by place, the longest texts first in each
        width = np.searchsorted(-size, -np.arange(size[0]), side="left")
        offset = np.concatenate(([0], np.cumsum(width)))
        stay = np.zeros((offset[-1], len(self.names)), bool)
        top = np.zeros(offset[-1], np.int64)
        total = scores[codes[begin[:live]]].astype(np.float64)
        finals = np.zeros(live, np.int64)
        for k in range(1, int(size[0])):
            m = width[k]
            if m < len(total):
                finals[m : len(total)] = total[m:].argmax(1)
                total = total[:m]
            best = total.argmax(1)
            changed = total[np.arange(m), best][:, None] - SWITCH
            kept = total >= changed
            s = slice(offset[k], offset[k] + m)
            stay[s], top[s] = kept, best
            total = np.where(kept, total, changed) + scores[codes[begin[:m] + k]]
            total -= total.max(1, keepdims=True)
        finals[: len(total)] = total.argmax(1)
        now = finals
        for k in range(int(size[0]) - 1, -1, -1):
            m = width[k]
            label[begin[:m] + k] = now[:m]
            if k:
                s = slice(offset[k], offset[k] + m)
                now[:m] = np.where(stay[s][np.arange(m), now[:m]], now[:m], top[s])
        return label


def train(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """Counts over all training texts with a language; what is gathered is bounded by buckets x languages."""
    small_batches(docs.sparkSession)
    rows = docs.where(is_training & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(tidy(_counts(buckets)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return LanguageModel(counts.toPandas().astype({"n": "float64"}), buckets)


def labelled(model: LanguageModel, texts: pa.Array, with_spans: bool) -> tuple[list[str], np.ndarray, list[str]]:
    """The language of each text, its share of the letters, and the spans if asked."""
    distinct, codes, at = pieces_of(texts)
    n_texts = len(at) - 1
    if not model.names:
        return [UNDETERMINED] * n_texts, np.zeros(n_texts), [""] * n_texts
    scores, n_letters = model.word_scores(distinct)
    label = model.label(scores, codes, at)
    text = np.repeat(np.arange(n_texts), np.diff(at))
    share = np.bincount(text * len(model.names) + label, n_letters[codes], minlength=n_texts * len(model.names)).reshape(n_texts, -1)
    total, best = share.sum(1), share.argmax(1)
    score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
    names = [model.names[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist(), strict=True)]
    if not with_spans:
        return names, score, [""] * n_texts
    first = np.ones(len(label), bool)
    first[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(first)
    stop = np.append(begin[1:], len(label))
    owner = text[begin]
    cut = np.searchsorted(owner, np.arange(n_texts + 1))
    parts = [f"{model.names[v]}:{a}:{b}" for v, a, b in zip(label[begin].tolist(), (begin - at[owner]).tolist(), (stop - at[owner]).tolist(), strict=True)]
    return names, score, [",".join(parts[a:b]) if total[k] else "" for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, spans: one row for each row of ``docs``.

    score is the share of the letters that lie in spans of lang_pred; spans
    lists language:first piece:end piece; pieces are words, cut where the
    script changes and in scripts without spaces every few letters.  Texts that are null or without a
    letter, and all texts if nothing was learned, are ``und`` with score 0 and
    no spans.  Ties go to the language first by name.  Repeated rows and null
    ids are rows like others.  Other columns aren't read; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, model)

    def run(batches):
        model = opened(shared)
        for batch in slices(batches, "text"):
            names, score, spans = labelled(model, batch.column("text"), True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], ["id", "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double, spans string")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows whose crc32(id) mod 4 isn't 2, and predict all rows; adds held_out.

    Rows without a language aren't learned from; an empty table gives no rows.
    """
    held_out = crc_mod(id_col, 4) == 2
    out = predict(docs, train(docs, ~held_out, id_col), id_col)
    return out.withColumn("held_out", held_out).select(id_col, "held_out", "lang_pred", "score", "spans")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents that have a language, whatever the other columns are called.

    Rejected are texts that are null, empty or without a letter, and texts of
    which no language holds half of the letters.  Repeated rows are kept or
    rejected alike.  The model learns from all rows that have a language; if
    none has, all are rejected.
    """
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, train(docs, F.lit(True), id_col, text_col))

    def keep(batches):
        model = opened(shared)
        for batch in slices(batches, text_col):
            names, score, _ = labelled(model, batch.column(text_col), False)
            yield batch.filter(pa.array((np.array(names, object) != UNDETERMINED) & (score >= 0.5)))

    return docs.mapInArrow(tidy(keep), docs.schema)
