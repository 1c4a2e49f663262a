"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the character 2-, 3- and 4-grams of lower-cased words, with the space on either side. Their embeddings are
averaged over the whole text, so a trained model folds into one table of logits per bucket and a text costs one gather
and one sum per subword, however long it is; long texts are worked on in pieces whose sums are added.

A text is rejected if its subwords are not typical of any learned language: the mean log frequency that they have in the
training texts is under a threshold. (The best probability would not do: a text in two languages has a low one.) It is
calibrated on texts that were not trained on, and on negatives made of them: shuffled characters, random letters and
letters of scripts that no learned language uses. A short text tells less, so there is a threshold for each class of
length (numbers of subwords up to ``EVIDENCE``). Clean texts may fall under it at the rate CLEAN_LOSS, negatives over it
at JUNK_PASS; where both can't be had, clean texts come first. ``Model.errors`` reports both rates by class.

Defined results
---------------
* null text, or text without a letter: ``und``, score 0, rejected;
* otherwise a learned language with its calibrated probability; ``rejected`` as above;
* equal probabilities: the language that sorts first; repeated rows are all returned;
* no usable training row: every text is ``und``; extra columns are ignored.

The fit reads at most ``TRAIN_ROWS`` rows, about equally many of each language, picked by a hash of key and text; of a text of
more than TRAIN_CHARS characters it takes PLACES stretches of equal length at hashed places (bounds on the fit alone:
predictions use whole texts). Rows whose key is held out have no part in it, nor in the rates at which rows are picked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

BUCKETS = 1 << 16
DIM = 16
ORDERS = (2, 3, 4)
#: Rows of the fit, and characters that it takes of each: the whole text, or PLACES stretches of a longer one.
TRAIN_ROWS, TRAIN_CHARS, PLACES = 4000, 8192, 4
#: Each training text is learned by windows of so many characters at random places, so that short texts are learned too.
WINDOWS = (800, 240, 60, 20, 8)
EPOCHS = 4
#: Classes of length: at most so many subwords, and more.
EVIDENCE = (24, 96, 384)
#: The shares of clean texts that may be rejected, and of negatives that may pass.
CLEAN_LOSS, JUNK_PASS = 0.0005, 0.01
#: Scripts of the negatives, by their first and last letters.
SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x4E00, 0x5E00), (0xAC00, 0xB000))
HELD_OUT = 2
#: Bytes of text whose subwords are held at once.
WORK_BYTES = 256 << 10
#: Characters of a long text that are worked on at once.
PIECE = 1 << 17
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(text: str, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """The code points of a text in pieces, and how many subwords may start in each: they overlap by what a subword reads on."""
    whole = f" {text.lower()} "
    for lo in range(0, len(whole), size):
        own = whole[lo : lo + size + max(ORDERS) - 1]
        yield np.frombuffer(own.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), min(size, len(whole) - lo)


def subwords(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and buckets of the n-grams whose inner characters are letters and that hold a letter."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    is_letter = letters()[codes]
    own = np.where(is_letter, codes, np.uint32(32))
    m = len(codes) - n + 1
    ok = is_letter[1 : 1 + m].copy() if n > 2 else is_letter[:m] | is_letter[1 : 1 + m]
    for k in range(2, n - 1):
        ok &= is_letter[k : k + m]
    start = np.flatnonzero(ok)
    h = np.full(len(start), n, dtype=np.uint32)
    for k in range(n):
        h = (h ^ own[start + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return start, (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' subwords, text after text, and the text that each belongs to."""
    codes = [points(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    joined = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32)
    start, bucket = (np.concatenate(x) for x in zip(*(subwords(joined, n) for n in ORDERS), strict=True))
    return bucket, np.searchsorted(ends, start, "right")


class Model:
    """``table`` has the logits of each bucket and, in its last column, the log frequency of its subwords."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, thresholds: tuple[float, ...] = (-np.inf,) * (len(EVIDENCE) + 1), errors: tuple[tuple[float, float], ...] = ()):
        self.langs, self.table, self.bias, self.temperature, self.thresholds, self.errors = langs, table, bias, temperature, thresholds, errors

    def parts(self) -> tuple:
        return self.langs, self.table, self.bias, self.temperature, self.thresholds, self.errors

    def raw(self, texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, typicality and numbers of subwords."""
        total, count = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), dtype=np.int64)
        long_ = [k for k, t in enumerate(texts) if len(t) > piece]
        codes = [points(t if len(t) <= piece else "") for t in texts]
        joined = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32)
        ends = np.cumsum([len(c) for c in codes])
        for n in ORDERS:
            start, bucket = subwords(joined, n)
            edges = np.searchsorted(start, np.concatenate([[0], ends]))
            some = np.flatnonzero(np.diff(edges))
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], edges[some], axis=0)
            count += np.diff(edges)
        for k in long_:
            for own, starts in pieces(texts[k], piece):
                for n in ORDERS:
                    start, bucket = subwords(own, n)
                    bucket = bucket[: np.searchsorted(start, starts)]
                    total[k] += self.table[bucket].sum(axis=0)
                    count[k] += len(bucket)
        total /= np.maximum(count, 1)[:, None]
        return total[:, :-1] + self.bias, total[:, -1], count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if not self.langs:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        raw, typical, count = self.raw([t or "" for t in texts])
        p = softmax(raw / self.temperature)
        best = p.argmax(axis=1)
        rejected = typical < np.array(self.thresholds)[np.searchsorted(EVIDENCE, count)]
        return [(self.langs[b], float(q[b]), bool(r)) if n else (UNKNOWN, 0.0, True) for b, q, r, n in zip(best, p, rejected, count, strict=True)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def snippets(text: str, rng: np.random.Generator) -> list[str]:
    """Windows of the text at random places; of one that is no longer, all of it."""
    return [text[a : a + size] for size in WINDOWS for a in [int(rng.integers(0, max(1, len(text) - size + 1)))]]


def negatives(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts of no language, as long as ``texts``: each one's characters shuffled, random letters, and a foreign script."""
    out = []
    used = {c for t in texts for c in t.lower() if c.isalpha()}
    foreign = [s for s in SCRIPTS if not any(s[0] <= ord(c) <= s[1] for c in used)]
    alphabet = np.array(sorted(used) or ["a"])
    for t in texts:
        own = np.array(list(t))
        out.append("".join(own[rng.permutation(len(own))]))
        spaces = own == " "
        out.append("".join(np.where(spaces, " ", alphabet[rng.integers(0, len(alphabet), len(own))])))
        if foreign:
            lo, hi = foreign[int(rng.integers(0, len(foreign)))]
            out.append("".join(np.where(spaces, " ", np.array([chr(c) for c in rng.integers(lo, hi + 1, len(own))], dtype=own.dtype if len(own) else "U1"))))
    return out


def thresholds(clean: tuple[np.ndarray, np.ndarray], junk: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[float, ...], tuple[tuple[float, float], ...]]:
    """By class of length: the threshold of what is typical, and the shares of clean texts rejected and of junk passed.

    Where both targets can be met it lies in the middle of what meets them, else as high as clean texts allow."""
    at, errors = [], []
    for k in range(len(EVIDENCE) + 1):
        good, bad = (x[(np.searchsorted(EVIDENCE, n) == k) & (n > 0)] for x, n in (clean, junk))
        if not len(good) or not len(bad):
            at.append(-np.inf)
            errors.append((0.0, 1.0))
            continue
        most, least = np.quantile(good, CLEAN_LOSS, method="lower"), np.quantile(bad, 1 - JUNK_PASS, method="higher")
        t = float((most + least) / 2 if least <= most else most)
        at.append(t)
        errors.append((float((good < t).mean()), float((bad >= t).mean())))
    return tuple(at), tuple(errors)


def fit(rows: list[tuple[str, str]], seed: int = 8) -> Model:
    """A calibrated model of (text, language) rows. Every tenth row calibrates and is not trained on."""
    langs = sorted({y for _, y in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(0))
    rng = np.random.default_rng(seed)
    place = {y: k for k, y in enumerate(langs)}
    order = rng.permutation(len(rows))
    part = [[], []]
    for i, k in enumerate(order):
        text, y = rows[k]
        part[i % 10 == 9].extend((s, place[y]) for s in snippets(text, rng))
    train, held = part
    weight = np.zeros(len(langs))
    for _, y in train:
        weight[y] += 1
    weight = len(train) / (len(langs) * np.maximum(weight, 1))
    e, w, bias = rng.normal(0, 0.05, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    size = 64
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        mix = rng.permutation(len(train))
        for lo in range(0, len(mix), size):
            own = [train[k] for k in mix[lo : lo + size]]
            bucket, of = features([s for s, _ in own])
            count = np.maximum(np.bincount(of, minlength=len(own)), 1)
            sort = np.argsort(of, kind="stable")
            bucket, of = bucket[sort], of[sort]
            mean = np.zeros((len(own), DIM))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first):
                mean[of[first]] = np.add.reduceat(e[bucket], first, axis=0)
            mean /= count[:, None]
            y = np.array([k for _, k in own])
            error = softmax(mean @ w + bias)
            error[np.arange(len(own)), y] -= 1
            error *= weight[y][:, None] / len(own)
            back = error @ w.T / count[:, None]
            keys, inverse = np.unique(bucket, return_inverse=True)
            step = np.stack([np.bincount(inverse, back[of, d], len(keys)) for d in range(DIM)], axis=1) if len(keys) else np.zeros((0, DIM))
            w -= rate * mean.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            e[keys] -= 40 * rate * step
    seen = np.full(BUCKETS, 0.5)
    for lo in range(0, len(train), size):
        seen += np.bincount(features([s for s, _ in train[lo : lo + size]])[0], minlength=BUCKETS)
    model = Model(langs, np.column_stack([e @ w, np.log(seen / seen.sum())]), bias)
    held = held or train
    raw, typical, count = model.raw([s for s, _ in held])
    truth = np.array([y for _, y in held])
    told = count >= EVIDENCE[0]
    told = told if told.any() else count >= 0
    grid = np.geomspace(0.05, 5, 40)
    loss = [-np.log(np.maximum(softmax(raw[told] / t)[np.arange(told.sum()), truth[told]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    _, odd, odd_count = model.raw(negatives([s for s, _ in held], rng))
    model.thresholds, model.errors = thresholds((typical, count), (odd, odd_count))
    return model


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled rows (of at most as many languages) that are not held out, at a rate set for each language."""
    own = docs.where(~held_out(key)).select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang")).where("__text is not null and __lang is not null")
    counts = {r["__lang"]: r["count"] for r in own.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(rows).collect()}
    if not counts:
        return []
    rate = F.coalesce(*[F.when(F.col("__lang") == y, F.lit(rows / len(counts) / n)) for y, n in counts.items()])
    picked = own.where(F.pmod(F.xxhash64("__key", "__text", F.lit(8)), F.lit(1 << 30)) < rate * (1 << 30))
    n, each = F.length("__text"), TRAIN_CHARS // PLACES
    stretches = [F.col("__text").substr((F.pmod(F.xxhash64("__key", "__text", F.lit(k)), n - each + 1) + 1).cast("int"), F.lit(each)) for k in range(PLACES)]
    cut = F.when(n <= TRAIN_CHARS, F.array("__text")).otherwise(F.array(*stretches))
    found = picked.select(cut.alias("texts"), "__lang", F.xxhash64("__key", "__text", F.lit(9)).alias("h"), "__key").orderBy("h", "__key", "__lang").limit(rows).collect()
    return [(t, r["__lang"]) for r in found for t in r["texts"]]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row; one pass, no shuffle."""
    common.ready(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in common.slices(batches, "text", WORK_BYTES):
            own = own or Model(*shared.value)
            rows = own.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], schema=SCHEMA)

    own = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return predict(docs, fit(sample(docs, key)), key)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without rejected documents, in its own columns; one pass, no shuffle."""
    common.ready(docs)
    model = fit(sample(docs, key, text, lang))
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in common.slices(batches, text, WORK_BYTES):
            own = own or Model(*shared.value)
            yield batch.filter(pa.array([not r[2] for r in own.predict(batch.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
