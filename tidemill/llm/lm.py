"""Language-model scoring: word counts over the corpus and a recurrent model.

The counts of all training tokens give the base score, the vocabulary of the
recurrent model, and the probability of each word outside it.  The recurrent
model is trained by all training texts, each once: in every round each task
goes on from the same weights over its share, and the weights are averaged by
the tokens seen, in a tree.  The vocabulary grows with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import at_least, discard, materialize, opened, packed, shipped, starts_of, tidy, unpacked, unpacked_words, word_slices

#: Shares of the training texts (in sixteenths) and step sizes of the rounds.
ROUNDS = ((1, 0.03), (3, 0.015), (5, 0.009), (7, 0.0045))
#: No word has a space, so it stands for the end of a text.
END_WORD = " "
#: Numbers of the model that are averaged in one task, replicas at most, and replicas that are averaged together.
CHUNK, REPLICAS, BRANCH = 4096, 4096, 64
#: Tokens that a task scores together.
SCORE_TOKENS = 2_000_000
#: Most frequent words, in vocabularies, that are looked up without a shuffle.
FREQUENT = 32


def crc(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.int64)


def _word_counts(batches):
    """Occurrences of each word of a slice in its training texts; 0 where it has others only."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column("doc_ids")[row].as_py()
            training = crc(ids) % 5 != 1
            words = unpacked_words(batch.column("words")[row].as_py())
            at = starts_of(np.asarray(batch.column("n_words")[row].values))
            codes = unpacked(batch.column("codes")[row].as_py())
            n = np.bincount(codes[np.repeat(training, np.diff(at))], minlength=len(words))
            out = pa.concat_arrays([words.cast(pa.string()), pa.array([END_WORD], pa.string())])
            counts = np.append(n, training.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), batch.column("slice_id")[row].as_py())), pa.array(np.arange(len(out), dtype=np.int32)), out, pa.array(counts.astype(np.int64))], ["slice_id", "pos", "word", "n"])


def _rare_words(shared):
    """slice_id, pos and word of the distinct words of each slice that aren't frequent."""

    def run(batches):
        frequent = opened(shared).frequent
        for batch in batches:
            for row in range(batch.num_rows):
                words = unpacked_words(batch.column("words")[row].as_py()).cast(pa.string())
                pos = np.flatnonzero(~np.asarray(pc.is_in(words, value_set=frequent))) if len(words) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), batch.column("slice_id")[row].as_py(), np.int64)), pa.array(pos.astype(np.int32)), words.take(pa.array(pos))], ["slice_id", "pos", "word"])

    return run


class Vocabulary:
    """The numbered words, and the frequent words with their counts."""

    def __init__(self, top: list[tuple[str, int]], own: gru.Layout):
        self.numbered = [w for w, _ in top if w != END_WORD][: own.words - 2]
        self.frequent = pa.array([w for w, _ in top], pa.string())
        self.counts = np.array([n for _, n in top], np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, pa.array(self.numbered, pa.string()))
        return np.asarray(pc.fill_null(pc.add(found, 2), gru.OTHER), dtype=np.int64)


def _coded(batch: pa.RecordBatch, row: int, vocabulary: Vocabulary):
    words = unpacked_words(batch.column("words")[row].as_py()).cast(pa.string())
    ids = batch.column("doc_ids")[row].as_py()
    at = starts_of(np.asarray(batch.column("n_words")[row].values))
    codes = unpacked(batch.column("codes")[row].as_py())
    number = vocabulary.numbers(words) if len(words) else np.zeros(0, np.int64)
    return ids, at, codes, number, words


def _numbered(shared):
    """round, n_words and numbers of the training texts of each slice, a row for each round."""
    ends = np.cumsum([share for share, _ in ROUNDS])

    def run(batches):
        vocabulary = opened(shared)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, at, codes, number, _ = _coded(batch, row, vocabulary)
                c = crc(ids)
                turn = np.where(c % 5 != 1, np.searchsorted(ends, c // 5 % 16, side="right"), -1)
                size = np.diff(at)
                of_word = np.repeat(turn, size)
                for k in range(len(ROUNDS)):
                    if (turn == k).any():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([size[turn == k]], pa.list_(pa.int32())), pa.array([packed(number[codes[of_word == k]])], pa.binary())], ["round", "n_words", "numbers"])

    return run


def train(slices: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, own: gru.Layout) -> np.ndarray:
    """The averaged weights after all rounds."""
    spark = slices.sparkSession
    weights = gru.flat(gru.initial(counts, own), own)
    numbered = slices.select("doc_ids", "n_words", "codes", "words").mapInArrow(tidy(_numbered(shipped(spark, vocabulary))), "round int, n_words array<int>, numbers binary")
    numbered = materialize(numbered, "lm-numbered")
    for turn, (_, rate) in enumerate(ROUNDS):
        shared = shipped(spark, weights)

        def fit(batches, shared=shared, rate=rate):
            from pyspark import TaskContext

            trainer = gru.Trainer(gru.shaped(opened(shared), own), own, rate)
            for batch in batches:
                for row in range(batch.num_rows):
                    at = starts_of(np.asarray(batch.column("n_words")[row].values))
                    trainer.fit(unpacked(batch.column("numbers")[row].as_py()), at, np.arange(len(at) - 1))
            if trainer.seen:
                values = gru.flat(trainer.p, own)
                branch = TaskContext.get().partitionId() // BRANCH
                for k in range(0, len(values), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([branch], pa.int32()), pa.array([float(trainer.seen)]), pa.array([values[k : k + CHUNK].tobytes()], pa.binary())], ["chunk", "branch", "seen", "part"])

        def mean(table: pa.Table) -> pa.Table:
            seen = np.asarray(table["seen"])
            total = sum(s * np.frombuffer(x, np.float32).astype(np.float64) for s, x in zip(seen, table["part"].to_pylist(), strict=True))
            return pa.table({"chunk": table["chunk"].slice(0, 1), "seen": pa.array([seen.sum()]), "part": pa.array([(total / seen.sum()).astype(np.float32).tobytes()], pa.binary())})

        # no task averages more than max(BRANCH, REPLICAS / BRANCH) parts
        kind = "chunk int, seen double, part binary"
        fitted = numbered.where(F.col("round") == turn).coalesce(REPLICAS).mapInArrow(tidy(fit), "chunk int, branch int, seen double, part binary")
        means = fitted.groupBy("chunk", "branch").applyInArrow(mean, kind).groupBy("chunk").applyInArrow(mean, kind).collect()  # as long as the model
        if means:
            weights = np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(means, key=lambda r: r.chunk)])
    discard(numbered)
    return weights


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are the words, A-Z lower-cased, and one end.  Rows whose crc32(id)
    mod 5 isn't 1 are learned from; null and empty texts are an end alone.
    ``score`` is the log10 probability of the whole text by the recurrent
    model, which is a proper distribution over texts of the words counted and
    one unseen word.  Repeated rows are scored alike and counted each, and a
    null id counts as an empty one.  Other columns aren't read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    slices = materialize(word_slices(docs, id_col, text_col, lower=True), "lm-slices")
    occurrences = slices.mapInArrow(tidy(_word_counts), "slice_id long, pos int, word string, n long")
    counts = materialize(occurrences.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = int(total.n or 0), int(total.v)
    own = gru.layout(v_all)
    cut = at_least(counts, "n", FREQUENT * own.words)
    top = sorted(((r.word, r.n) for r in counts.where(F.col("n") >= cut).collect()), key=lambda x: (-x[1], x[0]))  # bounded by FREQUENT vocabularies
    vocabulary = Vocabulary(top, own)
    times = dict(top)
    own_end = int(counts.where(F.col("word") == END_WORD).agg(F.sum("n")).first()[0] or 0)
    numbered = np.array([own_end, 0, *(times[w] for w in vocabulary.numbered)], np.float64)
    numbered = np.pad(numbered, (0, own.words - len(numbered)))
    n_other, v_other = n_all - numbered.sum(), v_all - len(vocabulary.numbered) - (own_end > 0)
    numbered[gru.OTHER] = n_other
    weights = train(slices, vocabulary, numbered, own)

    # counts of the words of each slice: frequent words by broadcast, the others by a join
    rare = slices.select("slice_id", "words").mapInArrow(tidy(_rare_words(shipped(spark, vocabulary))), "slice_id long, pos int, word string")
    back = rare.join(counts.where(F.col("n") < cut), "word").groupBy("slice_id").agg(F.collect_list(F.struct("pos", "n")).alias("found"))
    shared = shipped(spark, (weights, vocabulary))

    def score(batches):
        values, vocabulary = opened(shared)
        p = gru.shaped(values, own)
        norm = np.log10(n_all + 0.5 * (v_all + 1))
        held: list[tuple] = []

        def flush():
            number = np.concatenate([x[1] for x in held])
            size = np.concatenate([np.diff(x[2]) for x in held])
            lm = gru.score(p, own, number, starts_of(size)) / np.log(10)
            done = 0
            for ids, _, at, base, other, n_known in held:
                n = len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(crc(ids) % 5 == 1), pa.array(np.diff(at) + 1), pa.array(n_known, pa.int64()), pa.array(np.full(n, n_all)), pa.array(base, pa.float64()), pa.array(lm[done : done + n] + other, pa.float64()),
                ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                done += n
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                ids, at, codes, number, words = _coded(batch, row, vocabulary)
                count = np.zeros(len(words), np.int64)
                if len(words):
                    frequent = pc.index_in(words, vocabulary.frequent)
                    known = np.asarray(frequent.is_valid())
                    count[known] = vocabulary.counts[np.asarray(frequent.drop_null(), dtype=np.int64)]
                found = batch.column("found")[row]
                if found.is_valid and len(found.values):
                    pos, n = (np.asarray(found.values.field(k)) for k in (0, 1))
                    inside = pos < len(words)  # the end has a place of its own
                    count[pos[inside]] = n[inside]
                text = np.repeat(np.arange(len(ids)), np.diff(at))
                sums = lambda x, text=text, codes=codes, n=len(ids): np.bincount(text, x[codes], minlength=n) if len(codes) else np.zeros(n)
                other = sums(np.where(number == gru.OTHER, np.log10(count + 0.5) - np.log10(n_other + 0.5 * (v_other + 1)), 0.0))
                base = sums(np.log10(count + 0.5) - norm) + np.log10(own_end + 0.5) - norm
                held.append((ids, number[codes].astype(np.int32), at, base, other, sums(count > 0).astype(np.int64) + (own_end > 0)))
                if sum(len(x[1]) for x in held) >= SCORE_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    scored = slices.join(back, "slice_id", "left").select("doc_ids", "n_words", "codes", "words", "found")
    return scored.mapInArrow(tidy(score), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
