"""Language spans: scripts narrow the candidates, Viterbi over word scores labels every word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import mix64, slices, words
from .common import free

UNKNOWN = "und"
#: Documents read for training, for each language at most (about): the model is fit on this sample.
TRAIN_DOCS = 5000
FEATURE_BITS = 16
ORDERS = 4
#: A word speaks for a language by at most this much, and a change of language costs twice as much.
WORD_CAP = 4.0
SWITCH = 8.0
#: A language is a candidate for words of a script that held this share of its training letters.
SCRIPT_SHARE = 0.01
MIN_SCORE = 0.5
SLICE_BYTES = 8 << 20
#: Distinct words of a slice become features in runs of about so many bytes, since a run takes some hundred times its size.
WORD_BYTES = 1 << 18

# First code points of ranges of scripts (fixed values), in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E00, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
N_SCRIPTS = len(SCRIPT_NAMES)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the id's text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Words:
    """Distinct words as features: hashed letter n-grams with word bounds, letters and script."""

    def __init__(self, distinct: pa.Array):
        n = len(distinct)
        text = ("\n" + "\n".join(distinct.to_pylist()).lower() + "\n") if n else "\n"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        kinds, code = np.unique(points, return_inverse=True)
        alpha = np.array([chr(k).isalpha() for k in kinds])[code]
        bound = points == 10
        points, bound = points[alpha | bound], bound[alpha | bound]
        word = np.cumsum(bound) - 1  # a bound belongs to the word after it
        self.letters = np.bincount(word[~bound], minlength=n)[:n]
        first = np.flatnonzero(bound[:-1] & ~bound[1:]) + 1
        self.script = np.full(n, -1)
        self.script[word[first]] = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, points[first], side="right") - 1]
        owners, buckets = [], []
        key = np.where(bound, 1, points + 2).astype(np.uint64)
        for order in range(1, ORDERS + 1):
            m = len(points) - order + 1
            if m <= 0:
                break
            inner = np.zeros(m, dtype=bool)
            for k in range(1, order - 1):
                inner |= bound[k : k + m]
            good = ~inner & ~(bound[:m] & bound[order - 1 : order - 1 + m])
            h = np.zeros(m, dtype=np.uint64)
            for k in range(order):
                h = h * np.uint64(0x9E3779B97F4A7C15) + key[k : k + m]
            at = np.flatnonzero(good)
            owners.append(word[at])
            buckets.append((mix64(h[at] + np.uint64(order)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        self.owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        self.bucket = np.concatenate(buckets) if buckets else np.empty(0, np.int64)

    def scores(self, model: dict) -> np.ndarray:
        """Words by languages: 0 for the best language, down to minus WORD_CAP; no evidence is 0 for all."""
        n, table = len(self.letters), model["table"]
        out = np.empty((n, len(model["langs"])), dtype=np.float32)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(self.owner, weights=table[k][self.bucket], minlength=n)[:n]
        allowed = model["scripts"][:, self.script].T & (self.script >= 0)[:, None]
        narrowed = allowed.any(axis=1, keepdims=True)
        out = np.where(narrowed & ~allowed, -np.inf, out)
        out -= out.max(axis=1, keepdims=True)
        out = np.maximum(out, -WORD_CAP)
        out[narrowed[:, 0]] = np.where(allowed[narrowed[:, 0]], out[narrowed[:, 0]], -2 * WORD_CAP)
        out[self.letters == 0] = 0
        return out


def word_features(distinct: pa.Array) -> Iterator[tuple[int, Words]]:
    """The features of all distinct words, a run of words after the other, each with the number of its first word."""
    at = 0
    for run in slices(pa.record_batch([distinct], names=["word"]), "word", WORD_BYTES):
        yield at, Words(run.column("word"))
        at += run.num_rows


def viterbi(scores: np.ndarray, word: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word, for all texts at once, one position after the other."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = starts[:-1][order], lengths[order]
    longest, states = (int(lengths[0]) if len(lengths) else 0), scores.shape[1]
    labels = np.zeros(len(word), dtype=np.int32)
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    best = np.zeros((len(order), states), dtype=np.float64)
    came = np.empty((len(word), states), dtype=np.uint8 if states < 256 else np.int32)
    rows, own = np.arange(len(order)), np.arange(states)
    for t in range(longest):
        a = active[t]
        at = begin[:a] + t
        now = best[:a]
        if t:
            top = now.argmax(axis=1)
            moved = now[rows[:a], top] - switch
            stay = now >= moved[:, None]
            came[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, moved[:, None])
        best[:a] = now + scores[word[at]]
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        labels[at] = state[:a]
        if t:
            state[:a] = came[at, state[:a]]
    return labels


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of features and of letters by script for each language of one partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            distinct, word, starts = words(part.column("text"))
            langs = part.column("lang").dictionary_encode()
            of_doc = langs.indices.to_numpy(zero_copy_only=False)
            of_word = np.repeat(of_doc, np.diff(starts))
            places, times_at = np.unique(of_word.astype(np.int64) * len(distinct) + word, return_counts=True)
            for at, feats in word_features(distinct):
                known = feats.script >= 0
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    first = k * len(distinct) + at
                    own = slice(*np.searchsorted(places, [first, first + len(feats.letters)]))
                    times = np.zeros(len(feats.letters), np.int64)
                    times[places[own] - first] = times_at[own]
                    table = counts.setdefault(lang, np.zeros((1 << FEATURE_BITS) + N_SCRIPTS))
                    table[: 1 << FEATURE_BITS] += np.bincount(feats.bucket, weights=times[feats.owner], minlength=1 << FEATURE_BITS)
                    table[1 << FEATURE_BITS :] += np.bincount(feats.script[known], weights=(times * feats.letters)[known], minlength=N_SCRIPTS)
    for lang, table in counts.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(table[at].astype(np.int64))], names=["lang", "feature", "n"]
        )


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> dict:
    """A model from labelled documents that are not held out: hashed n-gram logs and scripts per language.

    About ``train_docs`` documents of each language are read, chosen by a hash of id and text, all if
    there are fewer. What reaches the driver is bounded by the number of languages times features.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")
    )
    rates = labelled.groupBy("lang").count().select("lang", (F.lit(float(train_docs)) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit(7), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("text", "lang")  # one row for each language
    counts = sample.mapInArrow(_training_counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(langs), (1 << FEATURE_BITS) + N_SCRIPTS))
    lang_at = {lang: k for k, lang in enumerate(langs)}
    table[[lang_at[x] for x in counts.column("lang").to_pylist()], counts.column("feature").to_numpy()] = counts.column("n").to_numpy()
    grams, scripts = table[:, : 1 << FEATURE_BITS] + 0.5, table[:, 1 << FEATURE_BITS :]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "table": logs, "scripts": np.hstack([allowed, np.zeros((len(langs), 1), dtype=bool)])}


def _label(texts: pa.Array, model: dict, with_spans: bool) -> tuple[pa.Array, pa.Array, pa.Array | None]:
    distinct, word, starts = words(texts)
    n, k = len(texts), len(model["langs"])
    letters, scores = np.zeros(len(distinct), np.int64), np.zeros((len(distinct), k), np.float32)
    for at, feats in word_features(distinct) if k else ():
        letters[at : at + len(feats.letters)] = feats.letters
        scores[at : at + len(feats.letters)] = feats.scores(model)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    letters = letters[word]
    total = np.bincount(doc, weights=letters, minlength=n)
    if not k:
        spans = pa.array([[] for _ in range(n)], SPANS) if with_spans else None
        return pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), spans
    labels = viterbi(scores, word, starts)
    held = np.bincount(doc * k + labels, weights=letters, minlength=n * k).reshape(n, k)
    top = held.argmax(axis=1)
    none = total == 0
    names = pa.array(model["langs"] + [UNKNOWN]).take(pa.array(np.where(none, k, top)))
    score = np.where(none, 0.0, held[np.arange(n), top] / np.maximum(total, 1))
    spans = None
    if with_spans:
        new = np.ones(len(word), dtype=bool)
        new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(word))
        fields = [pa.array(model["langs"]).take(pa.array(labels[at])), pa.array((at - starts[doc[at]]).astype(np.int32)), pa.array((ends - at).astype(np.int32))]
        offsets = np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["lang", "word", "n_words"]))
    return names, pa.array(score), spans


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.int32()), ("n_words", pa.int32())]))
SPANS_TYPE = T.ArrayType(
    T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
)


def identify(
    docs: DataFrame, model: dict, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", spans_name: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Adds predicted language and score (and spans) to documents; only the text decides.

    Every word gets a language by Viterbi over word scores with a penalty for changes, words of a
    script being narrowed to its languages. The prediction is the language of most letters, the smaller
    name in a tie, and the score its share of all letters. A text that is null or has no letter is
    ``und`` with score 0, and so is every text if nothing was learned. Spans give the first word and
    number of words of each run, words counted as runs without white space. Repeated rows each get their
    answer, and an empty table gives an empty table. A column that has the name of a result is replaced.
    """
    results = {name.lower() for name in (lang_name, score_name, spans_name) if name}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep] + [T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]
    schema = T.StructType(fields + ([T.StructField(spans_name, SPANS_TYPE)] if spans_name else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                names, score, spans = _label(part.column(text_col), shared.value, spans_name is not None)
                columns = [part.column(c) for c in keep] + [names, score] + ([spans] if spans_name else [])
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, lang_name, score_name] + ([spans_name] if spans_name else []))

    return docs.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(run, schema)


def predict(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, held_out, lang_pred, score.

    Learns from documents that are not held out and have a language; without any, all are ``und``. Null texts and texts
    without letters are ``und`` with score 0, ties go to the smaller name, repeated rows get a row each. A null id
    has a null ``held_out`` and is not learned from. An empty table gives an empty table.
    """
    labelled = identify(docs.select(id_col, "text"), train(docs, id_col=id_col), keep=[id_col])
    return labelled.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in which one language has most letters; all columns stay.

    Rejected are texts without letters (null and empty ones among them) and those in which no language reaches
    ``min_score``. Repeated rows stay or go together; an empty table gives an empty table, and so does one
    without any learned language.
    """
    lang, score = free(docs, "lang_pred", "score")
    labelled = identify(docs, train(docs), lang_name=lang, score_name=score)
    return labelled.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
