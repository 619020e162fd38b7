"""Languages of documents and of their segments, by averaged hashed subword embeddings.

A sentence is the mean of the embeddings of its hashed character n-grams, taken word by word; a
linear softmax over it gives the language. Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows; as both are linear, their product, one row of
scores an n-gram bucket, is all that prediction needs. Labels are noisy: two fits on halves of the
sample find wrong labels in each other's half, the last fit learns from the rest. A temperature
fitted on held-out sentences calibrates the confidence, and sentences below the rejection level,
which weighs wrong answers against lost ones on the same sentences, belong to no language.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 17
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3, 4)
_MIX = np.random.default_rng(11).integers(1, 1 << 62, (len(ORDERS), max(ORDERS)), dtype=np.int64).astype(np.uint64) | np.uint64(1)

_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>|<\|\w+\|>")
_BLOCK = re.compile(r"</?(?:p|div|br|li|tr|h\d)\b", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+|[#@]\w+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Co}\p{Cn}]|(?![\n\t])\p{Cc}")
_END = re.compile(r"[.!?…][\"'»”)\]]*(?:\s+|$)|[。！？][」』）]*|\n+")
_WORDS = re.compile(r"[^\W\d_]+")
_MISREAD = re.compile(r"[ÃÂÐÑÅÄãÆ][\u0080-¿€-™ˆ˜–-•…‹›ŒœŠšŽžŸƒ]")
_CLOSING = "\"'»”)]」』 "
_STOPS = tuple(".!?…。！？")


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, read again where that gives valid text."""
    if not _MISREAD.search(text):
        return text

    def again(m: re.Match) -> str:
        for page in ("latin-1", "cp1252"):
            try:
                return m.group().encode(page).decode("utf-8")
            except UnicodeError:
                pass
        raw = b""
        for c in m.group():
            try:
                raw += c.encode("cp1252")
            except UnicodeError:
                if ord(c) > 255:
                    return m.group()
                raw += bytes([ord(c)])
        try:
            return raw.decode("utf-8")
        except UnicodeError:
            return m.group()

    return re.sub(r"[\u0080-ÿ€-™ˆ˜–-•…‹›ŒœŠšŽžŸƒ]+", again, text)


@dataclass
class Sentence:
    start: int
    end: int
    words: list[str]  # in lower case
    letters: int
    ended: bool


def _blank(m: re.Match) -> str:
    return ("\n" if _BLOCK.match(m.group()) else " ") * (m.end() - m.start())


def sentences(text: str | None) -> list[Sentence]:
    """Stretches between sentence ends, line ends and block tags, each with its words."""
    if not text:
        return []
    # markup is blanked, not cut, so that places keep their meaning in the text
    plain = _TAG.sub(_blank, text) if "<" in text else text
    # what the whole text does not hold need not be looked for in each sentence
    ascii_only = plain.isascii()
    entities, links = "&" in plain, "@" in plain or "#" in plain or "://" in plain or "www." in plain
    hidden = not plain.replace("\n", "").isprintable() and _HIDDEN.search(plain) is not None
    misread = not ascii_only and _MISREAD.search(plain) is not None
    out, at = [], 0
    for m in _END.finditer(plain):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(plain):
        out.append((at, len(plain)))
    found = []
    for a, b in out:
        t = plain[a:b]
        if misread:
            t = repaired(t)
        if entities:
            t = html.unescape(t)
        if links:
            t = _LINK.sub(" ", t)
        if hidden or entities or misread:
            t = _HIDDEN.sub("", t)
        if not ascii_only:
            t = unicodedata.normalize("NFC", t)
        words = _WORDS.findall(t.lower())
        found.append(Sentence(a, b, words, len("".join(words)), t.rstrip().rstrip(_CLOSING)[-1:] in _STOPS))
    return found


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word with its borders, and how many each word has."""
    code = np.frombuffer((" " + " \n ".join(words) + " \n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(code == 10) - (code == 10)
    last = np.flatnonzero(code == 10)[owner]
    found, where = [], []
    for k, n in enumerate(ORDERS):
        h = np.zeros(max(0, len(code) - n + 1), np.uint64)
        for j in range(n):
            h += code[j : j + len(h)] * _MIX[k, j]
        h ^= h >> np.uint64(31)
        inside = np.flatnonzero(last[: len(h)] - np.arange(len(h)) >= n)
        found.append(((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
        where.append(owner[inside])
    bucket, who = np.concatenate(found), np.concatenate(where)
    order = np.argsort(who, kind="stable")
    return bucket[order], np.bincount(who, minlength=len(words))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, `counts` at a time; 0 where there are none."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    has = counts > 0
    if has.any():
        out[has] = np.add.reduceat(values, (np.cumsum(counts) - counts)[has], axis=0)
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Bags:
    """Sentences as numbers of distinct words, and those words as n-gram buckets."""

    def __init__(self, found: list[list[str]]):
        flat = list(chain.from_iterable(found))
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        self.tokens = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.buckets, self.many = grams(list(number)) if number else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.first = np.cumsum(self.many) - self.many
        self.sizes = _sums(self.many[self.tokens, None], self.lengths)[:, 0]

    def __len__(self) -> int:
        return len(self.lengths)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.5

    def logits(self, bags: Bags) -> np.ndarray:
        """Each distinct word is scored once, sentences are sums of their words."""
        step, words = 1 << 16, []
        for k in range(0, len(bags.many), step):
            n = bags.many[k : k + step]
            words.append(_sums(self.scores[bags.buckets[bags.first[k] : bags.first[k] + n.sum()]], n))
        if not words:
            return np.tile(self.bias, (len(bags), 1))
        table = np.concatenate(words)
        return _sums(table[bags.tokens], bags.lengths) / np.maximum(bags.sizes, 1)[:, None].astype(np.float32) + self.bias

    def confidence(self, found: list[list[str]]) -> np.ndarray:
        """Calibrated probability of each language for each sentence, given by its words."""
        return _softmax(self.logits(Bags(found)) / self.temperature) if found else np.zeros((0, len(self.languages)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _descend(bags: Bags, y: np.ndarray, keep: np.ndarray, weigh: np.ndarray, *, dim: int, steps: int, batch: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, bias) fitted to the sentences `keep` by stochastic gradient descent.

    Each row of the embeddings divides its step by the root of its summed squared slopes, so that an
    n-gram of every sentence moves no further than a rare one and no rate makes the fit diverge.
    """
    rng = np.random.default_rng(seed)
    classes = len(weigh)
    table = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weight, bias = rng.normal(0, 0.3, (dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    g_table, g_weight, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((dim, classes), 1e-8, np.float32), np.full(classes, 1e-8, np.float32)
    queue = np.zeros(0, np.int64)
    for step in range(steps):
        if len(queue) < batch:
            queue = np.concatenate([queue, rng.permutation(keep)])
        some, queue = queue[:batch], queue[batch:]
        pace = rate * (1 - step / steps)
        n = bags.lengths[some]
        words, token, times = np.unique(bags.tokens[_spread(bags.starts[some], n)], return_inverse=True, return_counts=True)
        size = bags.sizes[some][:, None].astype(np.float32)
        own = bags.buckets[_spread(bags.first[words], bags.many[words])]
        x = _sums(_sums(table[own], bags.many[words])[token], n) / size
        slope = _softmax(x @ weight + bias)
        slope[np.arange(len(some)), y[some]] -= 1
        slope *= weigh[y[some], None] / len(some)
        back = np.repeat(slope @ weight.T / size, n, axis=0)[np.argsort(token, kind="stable")]
        back = np.repeat(_sums(back, times), bags.many[words], axis=0)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        rows, g = own[order][first], np.add.reduceat(back[order], first, axis=0)
        g_table[rows] += (g * g).mean(axis=1)
        table[rows] -= pace * g / np.sqrt(g_table[rows])[:, None]
        g, h = x.T @ slope, slope.sum(axis=0)
        g_weight += g * g
        g_bias += h * h
        weight -= pace * g / np.sqrt(g_weight)
        bias -= pace * h / np.sqrt(g_bias)
    return table @ weight, bias


def train(found: list[list[str]], labels: list[str], *, dim: int = 16, epochs: int = 3, least_steps: int = 150, batch: int = 256, rate: float = 0.1, seed: int = 3, cost: float = 3.0) -> LanguageModel:
    """Fits sentences, given by their words, to their noisy labels.

    Two fits on halves drop the labels that they find wrong in each other's half; the last fit learns
    nine tenths of the rest and is calibrated on the other tenth. A wrong answer counts as much as
    `cost` lost ones. A fit that is not finite raises an error; none is ever used.
    """
    languages = sorted(set(labels))
    bags = Bags(found)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    lot, usable = rng.random(len(bags)), bags.sizes > 0

    def fit(keep: np.ndarray, weigh: np.ndarray, rounds: int, mark: int) -> LanguageModel:
        steps = max(least_steps, rounds * -(-len(keep) // batch))
        scores, bias = _descend(bags, y, keep, weigh, dim=dim, steps=steps, batch=batch, rate=rate, seed=seed + mark)
        if not (np.isfinite(scores).all() and np.isfinite(bias).all()):
            raise ArithmeticError("the fit of the language model is not finite; use a smaller rate")
        return LanguageModel(languages, scores, bias)

    half = lot < 0.5
    wrong = np.zeros(len(bags), bool)
    for mark, side in enumerate((half, ~half)):
        if (usable & side).any() and (usable & ~side).any():
            # labels as delivered: wrong ones are a minority of their language only in natural proportions
            p = _softmax(fit(np.flatnonzero(usable & side), np.ones(len(languages), np.float32), max(2, epochs // 2), mark).logits(bags))
            wrong |= ~side & (p.argmax(axis=1) != y) & (p.max(axis=1) > 0.5)
    right = usable & ~wrong
    held = right & ((lot * 20).astype(int) % 10 == 0)
    keep = np.flatnonzero(right & ~held)
    weigh = np.sqrt(len(keep) / len(languages) / np.maximum(np.bincount(y[keep], minlength=len(languages)), 1)).astype(np.float32)
    model = fit(keep, weigh, epochs, 2)
    if held.any():
        z, own = model.logits(bags)[held], y[held]
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(own)), own] + 1e-9).mean() for t in np.geomspace(0.25, 2, 16)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        sure, good = p.max(axis=1), p.argmax(axis=1) == own
        order = np.argsort(-sure)
        gain = np.cumsum(np.where(good[order], 1.0, -cost))
        model.reject = float(np.clip(sure[order][len(gain) - 1 - gain[::-1].argmax()], 0.5, 0.9))
    return model


@dataclass
class Segment:
    start: int
    end: int
    language: str
    confidence: float
    words: int
    letters: int
    ended: bool


def segments_of(found: list[Sentence], best: list[int], sure: list[float], main: int, main_sure: list[float], model: LanguageModel) -> list[Segment]:
    """Stretches of one language of a document, from its sentences, their best languages and confidences.

    A sentence is taken for another language than the document's main one only if it is sure, or
    hardly could be the main one; sentences below the rejection level belong to the stretch before.
    """
    out: list[Segment] = []
    for s, k, p, q in zip(found, best, sure, main_sure):
        if not s.letters:
            continue
        if k != main and not (p >= 0.9 or (p >= model.reject and q < 0.1)):
            k, p = main, q
        if p < model.reject and out and k == main:
            out[-1].end = s.end
            continue
        language = model.languages[k]
        # languages written without spaces count every second letter as a word
        words = s.letters // 2 if language == "ja" else len(s.words)
        if out and out[-1].language == language:
            t = out[-1]
            t.confidence = (t.confidence * t.letters + p * s.letters) / (t.letters + s.letters)
            t.end, t.words, t.letters, t.ended = s.end, t.words + words, t.letters + s.letters, t.ended or (s.ended and words >= 3)
        else:
            out.append(Segment(s.start, s.end, language, p, words, s.letters, s.ended))
    return _without_scraps(out, model.languages[main])


def classified(found: list[list[Sentence]], model: LanguageModel) -> Iterator[list[Segment]]:
    """The segments of each text, given by its sentences; all sentences are scored together."""
    p = model.confidence([s.words for one in found for s in one])
    size = np.array([s.letters for one in found for s in one], np.float64)
    counts = np.array([len(one) for one in found], np.int64)
    main = _sums(p * size[:, None], counts).argmax(axis=1) if len(p) else np.zeros(len(found), np.int64)
    best, sure = p.argmax(axis=1).tolist(), p.max(axis=1, initial=0).astype(float).tolist()
    main_sure = p[np.arange(len(p)), np.repeat(main, counts)].astype(float).tolist()
    at = 0
    for one, m in zip(found, main.tolist()):
        end = at + len(one)
        yield segments_of(one, best[at:end], sure[at:end], m, main_sure[at:end], model)
        at = end


def _without_scraps(parts: list[Segment], main: str, least_words: int = 4) -> list[Segment]:
    """Stretches of another language too short for a sentence (links, names, borrowed phrases) join their neighbour."""
    out: list[Segment] = []
    ahead = None
    for s in parts:
        if s.language != main and s.words < least_words and len(parts) > 1:
            if out:
                out[-1].end = s.end
            else:
                ahead = s.start if ahead is None else ahead
            continue
        if ahead is not None:
            s.start, ahead = ahead, None
        if out and out[-1].language == s.language:
            t = out[-1]
            t.confidence = (t.confidence * t.letters + s.confidence * s.letters) / (t.letters + s.letters)
            t.end, t.words, t.letters, t.ended = s.end, t.words + s.words, t.letters + s.letters, t.ended or s.ended
        else:
            out.append(s)
    return out or parts


def languages_held(segments: list[Segment], model: LanguageModel, least_words: int = 5) -> list[tuple[str, float]]:
    """Languages with at least one full sentence, each with the confidence of its best stretch."""
    whole: dict[str, int] = {}
    for s in segments:
        whole[s.language] = whole.get(s.language, 0) + s.letters
    main = max(whole, key=whole.get, default=None)
    held: dict[str, float] = {}
    for s in segments:
        if s.confidence >= model.reject and s.words >= (least_words if s.language != main else least_words - 1) and (s.ended or s.language == main):
            held[s.language] = max(held.get(s.language, 0.0), s.confidence)
    return sorted(held.items())


def training_sample(documents: DataFrame, aliases: DataFrame, *, key: str, text: str, label: str, alias: str, language: str, most: int = 5000) -> list[tuple[str, str]]:
    """At most `most` (text, language) rows with a known label, drawn by a hash of the key.

    This is the one part that does not use every row: the fit needs no more. Texts of 20 to 4,000
    characters are drawn, so that the sample is bounded in bytes too.
    """
    known = F.broadcast(aliases.where(F.col(alias).isNotNull() & F.col(language).isNotNull()).select(F.col(alias).alias("_label"), F.col(language).alias("_lang")).dropDuplicates(["_label"]))
    rows = documents.select(F.col(text).cast("string").alias("_text"), F.col(label).alias("_label"), F.xxhash64(F.col(key), F.lit(13)).alias("_h"))
    share = min(1.0, 3.0 * most / max(1, documents.count()))
    rows = rows.where(F.length("_text").between(20, 4000) & (F.pmod("_h", F.lit(1_000_000)) < int(share * 1_000_000)))
    return [(r["_text"], r["_lang"]) for r in rows.join(known, "_label").orderBy("_h", "_text").limit(most).select("_text", "_lang").collect()]


def fit_languages(documents: DataFrame, aliases: DataFrame, **columns) -> LanguageModel | None:
    """A model of the labelled sentences of a bounded sample; None if fewer than two languages are labelled."""
    found, labels = [], []
    for body, language in training_sample(documents, aliases, **columns):
        for s in sentences(body):
            if s.letters >= 12:
                found.append(s.words)
                labels.append(language)
    return train(found, labels) if len(set(labels)) > 1 else None


def identify_languages(documents: DataFrame, model: LanguageModel | None, *, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(key, languages, segments) for every row, with the columns `keep` beside them.

    `languages` holds (lang, confidence) of each language with a full sentence in the text,
    `segments` (start, end, lang, confidence) of each stretch, by places in the text. Both are empty
    for null, empty and letterless texts, and for every text if there is no model. Whole texts are
    read, one pass without a shuffle; other columns are not looked at.
    """
    keep = keep or []
    rows = documents.select(F.col(text).cast("string").alias("_text"), F.col(key).alias("_key"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    one, stretch = pa.struct([("lang", pa.string()), ("confidence", pa.float64())]), pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                found = [sentences(t) if known else [] for t in batch.column(0).to_pylist()]
                held, parts = [], []
                for own in classified(found, known) if known else [[]] * len(found):
                    held.append([{"lang": x, "confidence": c} for x, c in languages_held(own, known)] if own else [])
                    parts.append([{"start": x.start, "end": x.end, "lang": x.language, "confidence": x.confidence} for x in own])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(held, pa.list_(one)), pa.array(parts, pa.list_(stretch))], names=[*batch.schema.names[1:], "languages", "segments"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(run, f"{kinds}, languages array<struct<lang: string, confidence: double>>, segments array<struct<start: int, end: int, lang: string, confidence: double>>")
    return out.select(F.col("_key").alias(key), *[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "languages", "segments")
