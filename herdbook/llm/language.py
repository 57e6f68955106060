"""Languages of documents and of their paragraphs: words first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdbook.llm.lookalike import LOOK_ALIKES
from herdbook.runtime import cut

#: How a language may be written in a label (region suffixes aside), in any case.
NAMES = {
    "de": "de deu ger german deutsch allemand tedesco alemán aleman duits німецька",
    "fr": "fr fra fre french français francais französisch franzoesisch francese francés frances frans французька",
    "en": "en eng english englisch anglais inglese inglés ingles engels англійська",
    "it": "it ita italian italiano italienisch italien italiaans італійська",
    "es": "es spa esp spanish español espanol spanisch espagnol spagnolo castellano spaans іспанська",
    "nl": "nl nld dut dutch nederlands niederländisch niederlaendisch néerlandais neerlandais olandese neerlandés neerlandes holandés vlaams flemish нідерландська",
    "uk": "uk ukr ukrainian українська ukrainisch ukrainien ucraino ucraniano oekraïens oekraiens ukrainska",
}

#: A word or n-gram is known if it makes up at least this share of a language's words or n-grams: at most 1 / SHARE of each
#: kind for each language, whatever the corpus, so the model has a bounded size.
SHARE = 5e-5
ORDERS = (5, 4, 3, 2, 1)
FLOOR = 1e-6
#: A paragraph of so many words, or a document, of which less than a share is known in its best language is of none of them.
STRANGE_WORDS, STRANGE_SHARE = 12, 0.15
#: Bins of the evidence a word in which confidences are calibrated.
SURE_BINS = 40

_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“”\n]{1,200}[“”]")
_TO_LATIN = str.maketrans({k: v for k, v in LOOK_ALIKES.items() if len(v) == 1 and "Ͱ" <= k < "԰" and v.isalpha()})
_TO_CYRILLIC = str.maketrans({v: k for k, v in LOOK_ALIKES.items() if "а" <= k <= "я" or "А" <= k <= "Я" or k in "іІ"})
_OTHER_SCRIPT, _CYRILLIC, _LETTER = re.compile("[\u0370-\u052f]"), re.compile("[\u0400-\u052f]"), re.compile(r"[^\W\d_]")
_INVISIBLE = re.compile("[­͏​-‏‪-‮⁠-⁤︀-️﻿]")


def label_code(label: Column, names: dict[str, str] = NAMES) -> Column:
    """The language code that a label names, null if it names none of those known."""
    base = F.lower(F.regexp_replace(F.trim(label), r"[-_./ (].*$", ""))
    table = F.create_map(*(F.lit(x) for code, some in names.items() for n in some.split() for x in (n, code)))
    return F.try_element_at(table, base)


def words_of(paragraph: str) -> list[str]:
    """The lower-case words of a paragraph, in one script; quoted titles aside where two words or more are left."""
    if not paragraph.isascii():
        paragraph = U.normalize("NFKC", _INVISIBLE.sub("", paragraph))
        if _OTHER_SCRIPT.search(paragraph):
            own = sum(ord(c) not in _TO_LATIN for c in _CYRILLIC.findall(paragraph))
            if own and own * 10 >= len(_LETTER.findall(paragraph)):
                paragraph = " ".join(w.translate(_TO_CYRILLIC) if any("Ѐ" <= c < "԰" for c in w) else w for w in paragraph.split())
            else:
                paragraph = U.normalize("NFC", U.normalize("NFD", paragraph).translate(_TO_LATIN))
    words = _WORD.findall(_QUOTED.sub(" ", paragraph).lower())
    return words if len(words) >= 2 else _WORD.findall(paragraph.lower())


class Model:
    """Per-language log frequencies of known words and n-grams, the back-off, and what confidence some evidence deserves."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], grams: dict[str, list[float]], sure: list[float] | None = None) -> None:
        self.langs, self.grams, self.sure = langs, {g: np.asarray(v) for g, v in grams.items()}, sure
        self.known = len(words)
        self.at = {w: i for i, w in enumerate(words)}
        self.rows = np.zeros((len(words) + 50_000, len(langs)))
        if words:
            self.rows[:len(words)] = list(words.values())

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word that the model doesn't know: the mean of its longest n-grams of which half are known."""
        padded = f"^{word}$"
        for n in ORDERS:
            found = [g for g in (self.grams.get(padded[i:i + n]) for i in range(len(padded) - n + 1)) if g is not None]
            if len(found) * 2 >= max(1, len(padded) - n + 1):
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))

    def row(self, word: str) -> int:
        """The row of a word that isn't at hand; it is kept for the words to come."""
        i = len(self.at)
        self.rows[i] = self.unseen(word)
        self.at[word] = i
        return i

    def text(self, words: list[str]) -> tuple[np.ndarray, float]:
        """(the score of some words in each language, the share of them that the model knows)."""
        total, known, at = np.zeros(len(self.langs)), 0, self.at
        for start in range(0, len(words), 10_000):
            part = words[start:start + 10_000]
            if len(at) + len(part) > len(self.rows):
                missing = set(part) - at.keys()
                if len(at) + len(missing) > len(self.rows):
                    for w in [w for w, i in at.items() if i >= self.known]:
                        del at[w]
            rows = np.array([at[w] if w in at else self.row(w) for w in part])
            total += self.rows[rows].sum(0)
            known += int((rows < self.known).sum())
        return total, known / max(1, len(words))

    def document(self, text: str) -> tuple[list[tuple[int, str, float, int]], str, float]:
        """([(paragraph's number, language, confidence, bin of its evidence)], the document's language, confidence).

        A paragraph whose best languages are within 1.5 gets the document's if that is among them. A text without words, or
        of words that are hardly known in any language, is 'und' with confidence 0.
        """
        parts = [(i, words_of(p)) for i, p in enumerate(text.split("\n")) if p.strip()]
        scores = [(i, *self.text(w), len(w)) for i, w in parts]
        whole, n_all = sum((s for _, s, *_ in scores), np.zeros(len(self.langs))), sum(n for *_, n in scores)
        votes = np.zeros(len(self.langs))
        for _, s, share, n in scores:
            if n and not (n >= STRANGE_WORDS and share < STRANGE_SHARE):
                votes[int(s.argmax())] += n
        top = int(votes.argmax()) if votes.any() else -1
        out = []
        for i, s, share, n in scores:
            best = int(s.argmax())
            if n >= STRANGE_WORDS and share < STRANGE_SHARE:
                best = -1
            elif not n or not s.any() or (top >= 0 and s[top] >= s[best] - 1.5):
                best = top
            out.append((i, self.langs[best] if best >= 0 else "und", *self._sure(s, n, best)))
        return out, self.langs[top] if top >= 0 else "und", self._sure(whole, n_all, top)[0]

    def _sure(self, s: np.ndarray, n: int, best: int) -> tuple[float, int]:
        """(confidence in `best`, bin): the lead over the next language over the root of the number of words, calibrated."""
        if best < 0 or not n or len(s) < 2:
            return 0.0 if best < 0 or not n else 1.0, 0
        lead = float(s[best] - np.partition(np.delete(s, best), -1)[-1]) / n**0.5
        at = min(SURE_BINS - 1, max(0, int(2 * lead)))
        return (self.sure[at] if self.sure else 1 / (1 + float(np.exp(-lead)))), at


def calibrated(counts: list[tuple[int, int, int]]) -> list[float]:
    """Confidence by bin of evidence from (bin, paragraphs, those of their document's label): never falling, pooled where it
    would. Labels are wrong and documents mixed at a rate of their own, so shares are relative to the best-known bins'."""
    n, hit = np.zeros(SURE_BINS), np.zeros(SURE_BINS)
    for at, some, same in counts:
        n[at], hit[at] = n[at] + some, hit[at] + same
    blocks: list[list[float]] = []
    for at in range(SURE_BINS):
        blocks.append([hit[at] + 0.5, n[at] + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            h, m, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + m, blocks[-1][2] + k]
    share = np.concatenate([[h / m] * int(k) for h, m, k in blocks])
    return [float(x) for x in np.minimum(0.999, share / max(share.max(), 1e-9))]


def _counted(pairs: Iterator[tuple[str, list[str]]]) -> pd.DataFrame:
    counts: dict[str, Counter] = {}
    for lang, words in pairs:
        counts.setdefault(lang, Counter()).update(words)
    return pd.DataFrame([(a, b, n, 0) for a, c in counts.items() for b, n in c.items()], columns=["lang", "word", "n", "same"])


_COUNTS = "lang string, word string, n bigint, same bigint"


def _trained(counts: DataFrame, langs: list[str]) -> tuple[dict[str, list[float]], dict[str, list[float]], list[float] | None]:
    """The model's tables from (lang, word, n), counted over all texts, and from the bins of evidence among them (lang null)."""
    counts = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("same").alias("same")))
    bins = [(int(r["word"]), r["n"], r["same"]) for r in counts.where("lang IS NULL").collect()]  # SURE_BINS at most
    counts = counts.where("lang IS NOT NULL").drop("same")
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = None
    for order in ORDERS:
        some = counts.select("lang", "n", F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order}}}))"), F.lit(1))).alias("word"))  # overlapping, in one pass over the word
        some = some.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("kind", F.lit(order))
        grams = some if grams is None else grams.unionByName(some)
    every = cut(counts.withColumn("kind", F.lit(0)).unionByName(grams))
    totals = {(r["kind"], r["lang"]): r["n"] for r in every.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    size = F.element_at(F.create_map(*(F.lit(x) for (k, l), n in sorted(totals.items()) for x in (f"{k}{l}", float(n)))), F.concat(F.col("kind").cast("string"), F.col("lang"))) if totals else F.lit(1.0)
    every = every.withColumn("p", F.col("n") / size)
    known = every.groupBy("kind", "word").agg(F.max("p").alias("top"), F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("ps")).where(F.col("top") >= SHARE)
    words, forms = {}, {}
    for r in known.select("kind", "word", "ps").toLocalIterator():  # at most 1 / SHARE of each kind and language
        logs = [float(np.log(r["ps"].get(l, 0.0) + FLOOR)) for l in langs]
        mean = sum(logs) / len(logs)
        (forms if r["kind"] else words)[r["word"]] = [x - mean for x in logs]
    return words, forms, calibrated(bins) if bins else None


def languages(df: DataFrame, key: str, text: str, label: str, rounds: int = 2, names: dict[str, str] = NAMES) -> DataFrame:
    """(key, seg_no, seg_lang, confidence, doc_lang, doc_confidence, label_lang), one row for each paragraph that isn't blank.

    Paragraphs are the text's parts between line feeds, counted from 0 with blank ones. The languages are those of `names`
    (code -> how labels write it) that labels of the corpus name; the model is trained on the corpus itself: word counts by
    label over all labelled texts in the first round, by the language found for each paragraph in the next, which mends wrong
    labels and mixed texts. A word counts by its log frequency in each language; an unseen word, of any length, by the
    longest order of n-grams of which the model knows at least half. Words, n-grams and counts cover all texts; only those
    above a share of the corpus (SHARE) are kept, so the broadcast model has a bounded size.

    Confidence is calibrated on the corpus: how often paragraphs of as much evidence have their document's label, relative to
    those of the most. A paragraph of STRANGE_WORDS words or more of which hardly any is known is in another language: 'und',
    confidence 0. Null and blank texts give no rows. Without any usable label there is no model, and every language is 'und'.
    """
    docs = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), label_code(F.col(label), names).alias("_l")).where(F.col("_t").isNotNull() & F.col("_t").rlike(r"\S"))
    langs = sorted(r["_l"] for r in docs.where("_l IS NOT NULL").select("_l").distinct().collect())  # those of `names`
    if not langs:
        return docs.select(F.col("_k").alias(key), F.posexplode(F.split("_t", "\n")).alias("seg_no", "p")).where(F.col("p").rlike(r"\S")).select(
            key, "seg_no", F.lit("und").alias("seg_lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("doc_lang"), F.lit(0.0).alias("doc_confidence"), F.lit(None).cast("string").alias("label_lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _counted((lang, words_of(p)) for lang, t in zip(b["_l"], b["_t"]) for p in t.split("\n"))

    tables = _trained(docs.where("_l IS NOT NULL").select("_l", "_t").mapInPandas(count, _COUNTS), langs)
    sc = df.sparkSession.sparkContext
    for _ in range(rounds - 1):
        shared = sc.broadcast(tables)

        def recount(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model = Model(langs, *shared.value)
            for b in batches:
                pairs, bins = [], Counter()
                for t, label in zip(b["_t"], b["_l"]):
                    lines = t.split("\n")
                    for i, lang, _, at in model.document(t)[0]:
                        if lang != "und" and at >= 4:  # a lead of two roots of the number of words
                            pairs.append((lang, words_of(lines[i])))
                        if label is not None and lang != "und":
                            bins[at, lang == label] += 1
                sure = [(None, str(at), bins[at, True] + bins[at, False], bins[at, True]) for at in {at for at, _ in bins}]
                yield pd.concat([_counted(iter(pairs)), pd.DataFrame(sure, columns=["lang", "word", "n", "same"])])

        tables = _trained(docs.select("_t", "_l").mapInPandas(recount, _COUNTS), langs)
        shared.unpersist()
    shared = sc.broadcast(tables)

    def label_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(langs, *shared.value)
        for b in batches:
            rows = []
            for k, t, l in zip(b["_k"], b["_t"], b["_l"]):
                parts, lang, sure = model.document(t)
                rows += [(k, i, a, c, lang, sure, l) for i, a, c, _ in parts]
            yield pd.DataFrame(rows, columns=["k", "seg_no", "seg_lang", "confidence", "doc_lang", "doc_confidence", "label_lang"])

    kind = dict(docs.dtypes)["_k"]
    return docs.mapInPandas(label_all, f"k {kind}, seg_no int, seg_lang string, confidence double, doc_lang string, doc_confidence double, label_lang string").withColumnRenamed("k", key)
