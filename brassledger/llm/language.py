"""Language of words and documents by a linear-chain conditional random field.

Each word of a text is labelled. Its features are hashed character n-grams of
the word between two blanks, so that those at the ends are its affixes, and the
word itself (the lexicon); feature weights and label transitions are learned
together by gradient ascent on the conditional likelihood, whose expectations
come from forward-backward. A document's language is the one with the largest
mean posterior over its words, so code-switched text is split word by word
first. Texts are processed whole: a batch is cut into segments whose transfer
matrices are multiplied in lockstep, then joined document by document.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, short_batches

#: Labelled documents used for each language and in all, windows taken from each
#: document (spread over the whole text), and words in a window. With many
#: languages each has fewer documents; none is left out.
TRAIN_DOCS, TRAIN_TOTAL, WINDOWS, WINDOW_WORDS = 400, 25600, 4, 20
GRAMS = (2, 3, 4)
GRAM_BITS, LEXICON_BITS = 15, 16
SEGMENT = 128
UNDETERMINED = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_OFFSETS = [i << GRAM_BITS for i in range(len(GRAMS) + 1)]
SLOTS = _OFFSETS[-1] + (1 << LEXICON_BITS)
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (SLOTS, langs)
    transitions: np.ndarray  # (langs, langs), log scores


# --- features -------------------------------------------------------------


def has_letter(text: str) -> bool:
    """Numerals such as roman ones and fractions are no letters."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


class Words:
    """Words (UTF-8) in one buffer, with their feature slots."""

    def __init__(self, flat: list[bytes]):
        buf = np.frombuffer(b" " + b" ".join(flat) + b"    ", np.uint8)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        self.ends = np.cumsum(sizes + 1)
        self.starts = self.ends - sizes
        wide = buf.astype(np.uint32)
        self.grams = []
        for n in GRAMS:
            h = np.zeros(len(buf) - n + 1, np.uint32)
            for i in range(n):
                h = (h ^ wide[i : len(buf) - n + 1 + i]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(13)
            self.grams.append(h & np.uint32((1 << GRAM_BITS) - 1))
        # A word's hash wherever it stands: differences of a running polynomial.
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(buf), _BASE, np.uint64))
            run = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power)])
            back = np.cumprod(np.full(len(buf), pow(_BASE, -1, 1 << 64), np.uint64))
            h = (run[self.ends] - run[self.starts]) * back[self.starts] if len(flat) else np.empty(0, np.uint64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.lexicon = (h >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        lettered = np.concatenate([[0], np.cumsum((buf >= 128) | ((buf >= 97) & (buf <= 122)))])
        self.lettered = lettered[self.ends] > lettered[self.starts] if len(flat) else np.empty(0, bool)

    def ranges(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams of each word begin and end, blanks at both ends included."""
        first = self.starts - 1
        return first, np.maximum(first, self.ends + 2 - GRAMS[k])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = weights[_OFFSETS[-1] + self.lexicon].astype(np.float64)
        for k in range(len(GRAMS)):
            a, b = self.ranges(k)
            run = np.zeros((len(self.grams[k]) + 1, weights.shape[1]))
            np.cumsum(weights[_OFFSETS[k] + self.grams[k]], axis=0, dtype=np.float64, out=run[1:])
            out += run[b] - run[a]
        out[~self.lettered] = 0
        return out

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot, word) of every feature."""
        slots, words = [_OFFSETS[-1] + self.lexicon], [np.arange(len(self.starts))]
        for k in range(len(GRAMS)):
            a, b = self.ranges(k)
            n = b - a
            at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slots.append(_OFFSETS[k] + self.grams[k][at].astype(np.int64))
            words.append(np.repeat(np.arange(len(n)), n))
        return np.concatenate(slots), np.concatenate(words)


# --- training -------------------------------------------------------------


def _expectations(psi: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (B, T, L) and expected transitions (L, L) of equal chains."""
    n, t, k = psi.shape
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    a = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
    alpha[:, 0] = a
    for i in range(1, t):
        a = (a @ trans) * psi[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    for i in range(t - 2, -1, -1):
        b = (psi[:, i + 1] * beta[:, i + 1]) @ trans.T
        beta[:, i] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    right = psi[:, 1:] * beta[:, 1:]
    pair = alpha[:, :-1, :, None] * trans * right[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return post, pair.sum(axis=(0, 1))


def _even(windows: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Windows of equal length: the short ones of a language are joined, and the
    last of these begins again with the first words."""
    out, short = [x for x in windows if len(x[0]) == WINDOW_WORDS], defaultdict(list)
    for words, lang in windows:
        if len(words) < WINDOW_WORDS:
            short[lang] += words
    for lang, words in sorted(short.items()):
        for at in range(0, len(words), WINDOW_WORDS):
            own = words[at : at + WINDOW_WORDS]
            out.append((list(itertools.islice(itertools.chain(own, itertools.cycle(words)), WINDOW_WORDS)), lang))
    return out


def fit(windows: list[tuple[str, str]], epochs: int = 8, chain: int = 3, batch: int = 48, seed: int = 1) -> Model:
    """Fit on (words, language) windows of up to ``WINDOW_WORDS`` words.

    Chains join windows of random languages, so that transitions are learned
    from text that switches.
    """
    langs = sorted({lang for _, lang in windows})
    windows = [(split_words(w)[:WINDOW_WORDS], langs.index(lang)) for w, lang in windows]
    windows = _even(windows)
    k, rng = len(langs), np.random.default_rng(seed)
    weights, trans = np.zeros((SLOTS, k)), np.zeros((k, k))
    seen, seen_t = np.full(weights.shape, 1e-2), np.full(trans.shape, 1.0)
    if not windows or k < 2:
        return Model(langs, weights.astype(np.float32), trans)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        order = order[: max(chain, len(order) - len(order) % chain)]
        for at in range(0, len(order), batch * chain):
            own = [windows[i] for i in order[at : at + batch * chain]]
            own = own[: len(own) - len(own) % chain] or own
            n = max(1, len(own) // chain)
            words = Words([w for ws, _ in own for w in ws])
            gold = np.repeat([y for _, y in own], WINDOW_WORDS).reshape(n, -1)
            e = words.scores(weights).reshape(n, gold.shape[1], k)
            psi = np.exp(e - e.max(axis=2, keepdims=True))
            post, pairs = _expectations(psi, np.exp(trans))
            g = (np.eye(k)[gold] - post).reshape(-1, k)
            g[~words.lettered] = 0
            np.subtract.at(pairs, (gold[:, :-1], gold[:, 1:]), 1)
            slot, word = words.slots()
            touched, inverse = np.unique(slot, return_inverse=True)
            step = np.stack([np.bincount(inverse, g[word, c], len(touched)) for c in range(k)], axis=1)
            step -= 1e-3 * weights[touched]
            seen[touched] += step**2
            weights[touched] += 0.15 * step / np.sqrt(seen[touched])
            seen_t += pairs**2
            trans -= 0.3 * pairs / np.sqrt(seen_t) + 1e-4 * trans
    return Model(langs, weights.astype(np.float32), trans)


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """Windows of a bounded, seeded sample of labelled documents.

    Only documents whose crc32(id) mod 3 is not 1, with text and language, are
    used; of rows that repeat an id in a language one is (that with the least
    hash of its text). What reaches the driver is at most TRAIN_TOTAL (or one
    document a language) * WINDOWS * WINDOW_WORDS words.
    """
    key = F.crc32(F.col(id_col).cast("string"))
    usable = docs.where((key % 3 != 1) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    spot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    known = usable.select(F.col(lang_col).alias("lang"), spot.alias("h"))
    # Distinct ids, as rows may repeat one: the first filter below looks at ids.
    top = materialize(known.groupBy("lang").agg(F.countDistinct("h").alias("count")), "languages")
    docs_per_lang = max(1, min(docs_per_lang, TRAIN_TOTAL // max(1, top.count())))
    # About twice the wanted rows pass the first filter, however many there are;
    # only those are ranked.
    near = known.join(top, "lang").where(F.col("h") <= 2.0 * (docs_per_lang + 4) / F.col("count") * (1 << 30)).select("lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = near.withColumn("r", rank).where(F.col("r") <= docs_per_lang).groupBy("lang").agg(F.max("h").alias("last"))
    last = materialize(last, "language-bounds")  # one row a language

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = split_words(t)
            gap = max(0, len(w) - WINDOW_WORDS)
            starts = sorted({gap * i // max(1, WINDOWS - 1) for i in range(WINDOWS)})
            out.append([b" ".join(w[a : a + WINDOW_WORDS]).decode("utf-8", "replace") for a in starts])
        return pd.Series(out)

    rows = usable.select(F.col(lang_col).alias("lang"), spot.alias("h"), F.col(text_col).alias("t")).join(last, "lang").where("h <= last")
    rows = rows.groupBy("lang", "h").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("h", "lang", F.explode(cut("t")).alias("w"))
    return [(r["w"], r["lang"]) for r in rows.orderBy("h", "lang", "w").collect()]


# --- prediction -----------------------------------------------------------


def posteriors(e: np.ndarray, counts: np.ndarray, trans: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Posterior label probabilities of words whose scores are ``e``; ``counts``
    are the words of each document. Memory and steps do not grow with the
    longest document."""
    total, k = e.shape
    psi = np.exp(e - e.max(axis=1, keepdims=True)) if total else e
    t = np.exp(trans - trans.max())
    doc_start = np.cumsum(counts) - counts
    per_doc = -(-counts // segment)
    n = int(per_doc.sum())
    doc = np.repeat(np.arange(len(counts)), per_doc)
    nth = np.arange(n) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = doc_start[doc] + nth * segment
    size = np.minimum(segment, counts[doc] - nth * segment)
    by_size = np.argsort(-size, kind="stable")  # the segments still running are always the first ones
    place = np.empty(n, np.int64)
    place[by_size] = np.arange(n)
    start, size, doc, nth = start[by_size], size[by_size], doc[by_size], nth[by_size]
    running = [int(np.searchsorted(-size, -i, "left")) for i in range(segment)]  # size > i
    # 1. Each segment's transfer matrix; a document's first word has no transition.
    m = np.tile(np.eye(k), (n, 1, 1))
    for i in range(int(size.max(initial=0))):
        r = running[i]
        step = (m[:r].reshape(-1, k) @ t).reshape(-1, k, k)
        if i == 0:
            step[nth[:r] == 0] = np.eye(k)
        step *= psi[start[:r] + i][:, None, :]
        if i % 4 == 3:  # no underflow in between: a word's best label has psi = 1
            step /= step.sum(axis=(1, 2), keepdims=True)
        m[:r] = step
    m /= m.sum(axis=(1, 2), keepdims=True)
    # 2. Vectors at the segments' borders, document by document in lockstep.
    into, outof = np.full((n, k), 1 / k), np.ones((n, k))
    first = np.cumsum(per_doc) - per_doc
    for s in range(1, int(per_doc.max(initial=0))):
        d = np.flatnonzero(per_doc > s)
        prev, cur = place[first[d] + s - 1], place[first[d] + s]
        v = np.einsum("ni,nij->nj", into[prev], m[prev])
        into[cur] = v / v.sum(axis=1, keepdims=True)
    for s in range(int(per_doc.max(initial=0)) - 2, -1, -1):
        d = np.flatnonzero(per_doc > s + 1)
        cur, nxt = place[first[d] + s], place[first[d] + s + 1]
        v = np.einsum("nij,nj->ni", m[nxt], outof[nxt])
        outof[cur] = v / v.sum(axis=1, keepdims=True)
    # 3. Forward and backward inside the segments.
    out = np.empty((total, k))
    a = into
    for i in range(int(size.max(initial=0))):
        r = running[i]
        step = a[:r] @ t
        if i == 0:
            step[nth[:r] == 0] = a[:r][nth[:r] == 0]
        step *= psi[start[:r] + i]
        a = step / step.sum(axis=1, keepdims=True)
        out[start[:r] + i] = a
    b = outof
    for i in range(int(size.max(initial=0)) - 1, -1, -1):
        r = running[i]
        at = start[:r] + i
        out[at] *= b[:r]
        v = (psi[at] * b[:r]) @ t.T
        b[:r] = v / v.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True) if total else out


def label_batch(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each word, words of each text, mean posterior of each text)."""
    split = [split_words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)  # a word is scored once a batch
    which = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
    words, k = Words(list(known)), len(model.langs)
    post = posteriors(words.scores(model.weights)[which], counts, model.transitions)
    lettered = words.lettered[which]
    run = np.zeros((len(post) + 1, k + 1))
    np.cumsum(post * lettered[:, None], axis=0, out=run[1:, :k])
    np.cumsum(lettered, out=run[1:, k])
    ends = np.cumsum(counts)
    sums = run[ends] - run[ends - counts]
    return post, counts, sums[:, :k] / np.maximum(sums[:, k:], 1)


def predict(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and runs ("lang:first-last" of equal words).

    ``und`` with score 0 if the text is null or has no letter, or the model
    knows no language.
    """
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)  # a fixed number of weights

    @F.pandas_udf("lang_pred string, score double, runs string")
    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        known = [t if t and m.langs and has_letter(t) else None for t in texts]
        post, counts, means = label_batch(known, m) if m.langs else (np.empty((0, 0)), [0] * len(known), None)
        rows, at = [], 0
        for i, t in enumerate(known):
            own = post[at : at + counts[i]].argmax(axis=1) if counts[i] else np.empty(0, np.int64)
            at += counts[i]
            if t is None or not len(own):
                rows.append((UNDETERMINED, 0.0, ""))
                continue
            edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            runs = ",".join(f"{m.langs[own[a]]}:{a}-{b - 1}" for a, b in zip(edge, edge[1:], strict=False))
            best = int(means[i].argmax())
            rows.append((m.langs[best], min(1.0, float(means[i][best])), runs))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "runs"])

    return of(text)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runs) for each row.

    The model is fitted on the rows themselves, less those held out. Null ids
    are neither held out nor learned from. Rows that repeat are predicted alike;
    extra columns are ignored; an empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    model = fit(training_windows(docs, id_col, text_col, lang_col))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    out = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), predict(F.col(text_col), model).alias("p"))
    return out.select("doc_id", "held_out", "p.*")


#: Documents whose best language has a smaller share of the words are rejected.
MIN_SCORE = 0.4


def with_language(docs: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language: neither undetermined nor so mixed
    that no language has ``min_score`` of the words. All columns are returned.

    Null, empty and letterless texts go; so does every row if no language can be
    learned. Rows that repeat are all kept or all dropped; null ids take part,
    but are not learned from. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    model = fit(training_windows(docs, text_col=text_col))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(F.struct(*cols).alias("row"), predict(F.col(text_col), model).alias("p"))
    return found.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= min_score)).select("row.*")
