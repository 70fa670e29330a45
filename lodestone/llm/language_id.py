"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts become runs of lower-cased letters (with their combining marks) and single spaces between, behind ORDER - 1 begin
marks, so that every character from the first on is scored. Letters of all planes that the training texts hold are
numbered, the most frequent ones with one code each and those beyond DIRECT with two, as UTF-16 does; the others are one
letter that no model has seen. A model of order 4 is stored
as sorted arrays of n-gram keys, with a probability for each language. A text gets the language of lowest cross-entropy
for each character; it is rejected if that lies beyond what labelled texts show that the models were not fitted on, by a
margin which is wider for short texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, map_texts, materialise, text_chunks

ORDER = 4
#: At most about so many training texts of a language are read (the bound of the sample), chosen by a hash of their id.
SAMPLE = 1500
#: Of a language with fewer texts, this share is read, so that others are left to measure the limits on.
MOST_FITTED = 0.8
#: A text is rejected beyond the median cross-entropy of its language by so many deviations, at least MARGIN nats, and at least so many deviations of a mean over as many characters as it has (many, as one key or number may be half of a short text), up to WIDEST nats. Deviations are those of a normal distribution with the measured median deviation.
DEVIATIONS, MARGIN, SHORT_DEVIATIONS, WIDEST, NORMAL = 8.0, 1.0, 14.0, 2.5, 1.4826
#: How sharply the score tells languages apart: a language that is worse by this part of a nat a character has a share smaller by the factor e.
SHARPNESS = 0.25
UNKNOWN = "und"
_SPACE = 32
#: Letters that have a code of their own; the others have one of the FIRST codes and one of the SECOND, 2^10 of each at least, and one code is for unknown letters.
DIRECT, FIRST, SECOND, UNSEEN = 60_000, 60_001, 62_000, 65_535


@lru_cache(1)
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case if it is a letter, itself if it is a combining mark, else a space; and whether it is a letter."""
    table, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp], letter[cp] = ord(low) if len(low := c.lower()) == 1 else cp, True
        elif unicodedata.category(c)[0] == "M":
            table[cp] = cp
    return table, letter


def _code_points(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]


def numbering(code_points: np.ndarray) -> np.ndarray:
    """Number of each code point: 0 of a space, then those given (the most frequent first) from 1 on, and -1 of all others."""
    known = code_points[code_points != _SPACE]
    number = np.full(0x110000, -1, np.int32)
    number[known], number[_SPACE] = np.arange(1, len(known) + 1), 0
    return number


def letters(texts: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts' characters, each text between two spaces, runs of spaces as one; the text of each; and how many letters each text has."""
    folded, letter = _folded()
    parts = _code_points(texts)
    sizes = np.array([len(p) + 2 for p in parts], np.int64)
    codes = np.zeros(sizes.sum(), np.int32)
    begin = np.cumsum(sizes) - sizes
    table = number[folded]
    for b, p in zip(begin, parts, strict=True):
        codes[b + 1 : b + 1 + len(p)] = table[p]
    text = np.repeat(np.arange(len(parts)), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (text[1:] != text[:-1])
    codes, text = codes[keep], text[keep]
    if (codes > DIRECT).any():
        more = codes > DIRECT
        pairs = np.where(more, FIRST + (codes - DIRECT - 1) // 1024, codes)
        at = np.repeat(np.arange(len(codes)), 1 + more)
        second = np.r_[False, at[1:] == at[:-1]]
        codes, text = np.where(second, SECOND + (codes[at] - DIRECT - 1) % 1024, pairs[at]), text[at]
    return np.where(codes < 0, UNSEEN, codes).astype(np.uint16), text, np.array([letter[p].sum() for p in parts], np.int64)


def grams(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the ORDER codes up to each but a text's first, its space, and its text; before a text stand begin marks, which are spaces too."""
    c = codes.astype(np.uint64)
    key = c.copy()
    for j in range(1, ORDER):
        key[j:] |= np.where(text[j:] == text[:-j], c[:-j], np.uint64(0)) << np.uint64(16 * j)
    inside = np.r_[False, text[1:] == text[:-1]] if len(text) else np.zeros(0, bool)
    return key[inside], text[inside]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class KneserNey:
    """One language: for each order the sorted n-gram keys with discounted probabilities, and the weight that each context leaves to the next lower order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.tables, self.contexts, self.alphabet = {}, {}, alphabet
        for order in range(ORDER, 0, -1):
            shift = np.uint64(16)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, of, kinds = np.unique(keys >> shift, return_inverse=True, return_counts=True)
            total = np.bincount(of, counts, len(context))
            self.tables[order] = (keys, (counts - discount) / total[of])
            self.contexts[order] = (context, discount * kinds / total)
            if order > 1:  # lower orders count the different codes that stand before
                keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the last code of each key after the others."""
        p = np.full(len(keys), 1.0 / self.alphabet)
        for order in range(1, ORDER + 1):
            own = keys & np.uint64((1 << 16 * order) - 1)
            known, share = self.contexts[order]
            at, found = _find(known, own >> np.uint64(16))
            left = np.where(found, share[at] if len(share) else 1.0, 1.0)
            table, discounted = self.tables[order]
            at, found = _find(table, own)
            p = np.where(found, discounted[at] if len(discounted) else 0.0, 0.0) + left * p
        return np.log(p)


@dataclass
class Model:
    languages: list[str]
    number: np.ndarray  # of each code point
    parts: list[KneserNey]
    keys: np.ndarray  # n-grams of any language, sorted, and their log-probability in each
    logp: np.ndarray
    limit: np.ndarray  # highest cross-entropy that is not rejected, however long the text, by language
    middle: np.ndarray  # the median cross-entropy
    spread: np.ndarray  # deviation from it of a single character

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats for each character, [text, language], and the numbers of letters and of scored characters of each text."""
        codes, text, n_letters = letters(texts, self.number)
        key, text = grams(codes, text)
        unique, of = np.unique(key, return_inverse=True)
        at, found = _find(self.keys, unique)
        logp = self.logp[at] if len(self.keys) else np.zeros((len(unique), len(self.languages)))
        new = np.flatnonzero(~found)
        for i, part in enumerate(self.parts):
            logp[new, i] = part.log_probability(unique[new])
        n = np.bincount(text, minlength=len(texts))
        sums = np.stack([np.bincount(text, logp[of, i], len(texts)) for i in range(len(self.languages))], axis=1)
        return -sums / np.maximum(n, 1)[:, None], n_letters, n

    def rejects(self, language: np.ndarray, ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ce > np.maximum(self.limit[language], self.middle[language] + np.minimum(WIDEST, SHORT_DEVIATIONS * self.spread[language] / np.sqrt(np.maximum(n, 1))))


def _alphabet(docs: DataFrame) -> np.ndarray:
    """Numbers of the letters of these texts; at most as many rows as Unicode has letters reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = _folded()[0]
        for batch in batches:
            for _, texts in text_chunks(batch):
                unique, n = np.unique(folded[np.concatenate(_code_points(texts))], return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": unique.astype(np.int64), "n": n})

    found = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return numbering(np.array([r.code for r in sorted(found, key=lambda r: (-r.n, r.code))], np.int64))


def _counts(docs: DataFrame, number) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                names = part.column(0).dictionary_encode()
                lang = names.indices.to_numpy(zero_copy_only=False)
                key, text = grams(*letters(texts, number.value)[:2])
                for i, name in enumerate(names.dictionary.to_pylist()):
                    unique, n = np.unique(key[lang[text] == i], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(unique), pa.string()), "key": unique.view(np.int64), "n": n})

    return docs.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from lang and text of documents with both, outside the held-out fold; None if there are none.

    About `sample` texts of each language at most are fitted on, by a hash of the id; the n-grams of these reach the
    driver. The limits come from all other texts of these documents.
    """
    learn = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(MOST_FITTED, sample / n))])
    fitted = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    chosen = learn.where(fitted)
    context = docs.sparkSession.sparkContext
    number = _alphabet(chosen)
    numbered = context.broadcast(number)
    counts = _counts(chosen, numbered).toArrow()
    names = counts.column("lang").to_pylist()
    lang, key, n = np.array(names, object), counts.column("key").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    languages = sorted(set(names))
    if not languages:
        return None
    parts = []
    for name in languages:
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(key[own])]
        parts.append(KneserNey(key[own], n[own], min(int(number.max()) + 2, 1 << 16)))
    keys = np.unique(key)
    size = len(languages)
    model = Model(languages, number, parts, keys, np.stack([p.log_probability(keys) for p in parts], axis=1), np.full(size, np.inf), np.zeros(size), np.zeros(size))
    shared = context.broadcast(model)

    def measure(texts: pa.Array, batch: pa.RecordBatch) -> list:
        model = shared.value
        ce, letters, n = model.cross_entropy(texts)
        at = {x: i for i, x in enumerate(model.languages)}
        own = [at.get(x, -1) for x in batch.column(batch.schema.get_field_index("in_lang")).to_pylist()]
        return [np.where((letters > 0) & (np.array(own) >= 0), ce[np.arange(len(ce)), own], np.nan), n]

    measured = materialise(map_texts(learn.where(~fitted).select("lang", "text"), measure, "ce double, n long", needs=("lang",), keep_text=False).where(~F.isnan("ce")), "cross_entropies")
    middle = {r.lang: r.m for r in measured.groupBy("lang").agg(F.percentile_approx("ce", 0.5).alias("m")).collect()}
    if not middle:
        return model
    away = F.abs(F.col("ce") - F.create_map(*[F.lit(x) for kv in sorted(middle.items()) for x in kv])[F.col("lang")])
    for r in measured.groupBy("lang").agg(F.percentile_approx(away, 0.5).alias("d"), F.percentile_approx(away * F.sqrt("n"), 0.5).alias("s")).collect():
        i = languages.index(r.lang)
        model.middle[i], model.spread[i] = middle[r.lang], NORMAL * r.s
        model.limit[i] = middle[r.lang] + max(MARGIN, DEVIATIONS * NORMAL * r.d)
    return model


def identify(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1: how the normalised likelihood is shared among languages), cross_entropy and rejected.

    A text without letters (null, empty) is `und`, score 0, rejected; without any labelled text to learn from all are.
    Of equal cross-entropies the first language by name wins. Only the text decides; whole texts count, whatever their
    length; repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array, _: pa.RecordBatch) -> list:
        model = shared.value
        if model is None:
            return [[UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)]
        ce, letters, n = model.cross_entropy(texts)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best]
        with np.errstate(over="ignore"):
            score = 1.0 / np.exp((low[:, None] - ce) / SHARPNESS).sum(axis=1)
        none = letters == 0
        names = [UNKNOWN if x else model.languages[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
        return [names, np.where(none, 0.0, score), low, none | model.rejects(best, low, n)]

    return map_texts(docs, judge, "lang_pred string, score double, cross_entropy double, rejected boolean", keep_text=keep_text)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs), keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
