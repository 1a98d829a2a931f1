"""Language identification of mixed-language text.

Script ranges give each word its script and with it the candidate languages;
each word gets a log-score per candidate (character n-grams of the padded
word, naive Bayes, plus whole-word counts); Viterbi over the words with a
switching penalty labels spans.  The document's language is the one with the
most letters.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, id_number, id_text, ship

# First code points of the scripts that are told apart (each range ends where it says).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
)

UNKNOWN = "und"
ORDERS = (2, 3, 4)
#: Cost of changing the language between two words, in nats.
SWITCH = 6.0
#: No single word outweighs another language by more than this many nats.
CLIP = 8.0
#: Training rows at most, by a hash of their id.
TRAIN_ROWS = 4000

OUTPUT = "doc_id string, held_out boolean, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"
# letters with the marks that follow them (vowel signs, accents of decomposed text); no numerals of any kind
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+(?:['’]\p{L}[\p{L}\p{M}]*+)*+")


def script(word: str) -> str:
    code = ord(word[0])
    for name, first, last in SCRIPTS:
        if first <= code <= last:
            return name
    return "other"


class Model:
    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (text, language) of the training documents."""
        self.langs = sorted({lang for _, lang in rows})
        index = {lang: k for k, lang in enumerate(self.langs)}
        size = len(self.langs)
        words: dict[str, np.ndarray] = {}
        for text, lang in rows:
            k = index[lang]
            for w in _WORD.findall(text.lower()):
                if (at := words.get(w)) is None:
                    at = words[w] = np.zeros(size)
                at[k] += 1
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for w, count in words.items():
            # a frequent word teaches its n-grams as often as the square root of its count
            weight = np.sqrt(count)
            for g in self.grams_of(w):
                grams[g] = grams.get(g, 0) + weight
            scripts[script(w)] = scripts.get(script(w), 0) + count
        self.grams, self.gram_scores = self._logs(grams)
        self.words, self.word_scores = self._logs({w: c for w, c in words.items() if c.sum() >= 3})
        total = sum(scripts.values()) if scripts else np.zeros(size)
        #: languages written in each script: at least 2 % of their words
        self.scripts = {s: c >= 0.02 * np.maximum(total, 1) for s, c in scripts.items()}
        self.prior = int(np.argmax(total)) if size else 0

    def _logs(self, counts: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        """Row of each key in a table of log-scores; the last row, for unknown keys, is 0."""
        if not counts:
            return {}, np.zeros((1, max(1, len(self.langs))), np.float32)
        table = np.array(list(counts.values()))
        total = table.sum(axis=0)
        # smoothed by the language's own mass, centred: 0 says nothing about the language
        log = np.log((table + 0.5) / (total + 0.5 * len(counts)))
        log -= log.mean(axis=1, keepdims=True)
        return dict(zip(counts, range(len(counts)), strict=True)), np.concatenate([log, np.zeros((1, log.shape[1]))]).astype(np.float32)

    @staticmethod
    def grams_of(word: str) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + n] for n in ORDERS for i in range(len(padded) - n + 1)]

    def learned(self, name: str) -> bool:
        """Whether a learned language is written in this script."""
        return name in self.scripts and bool(self.scripts[name].any())

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: log-score of each language, 0 for the best one; whether its script is learned; share of its n-grams that are (2-grams aside)."""
        if not words:
            return np.zeros((0, max(1, len(self.langs))), np.float32), np.zeros(0, bool), np.zeros(0, np.float32)
        known, unknown, rows, starts = self.grams, len(self.grams), [], []
        for word in words:
            starts.append(len(rows))
            rows += [known.get(g, unknown) for g in self.grams_of(word)]
        score = np.add.reduceat(self.gram_scores[np.array(rows, np.int64)], starts) / len(ORDERS)
        score += self.word_scores[[self.words.get(w, len(self.words)) for w in words]]
        names = [script(w) for w in words]
        for name in set(names):
            written = self.scripts.get(name)
            if written is not None and written.any() and not written.all():
                of = [n == name for n in names]
                score[np.ix_(of, ~written)] = -np.inf
        within = {name for name in set(names) if self.learned(name)}
        ours = np.array([n in within for n in names])
        # the 2-grams come first, one more than the word has letters
        begin, pairs = np.array(starts, np.int64), np.fromiter(map(len, words), np.int64, len(words)) + 1
        hits = np.add.reduceat((np.array(rows, np.int64) != unknown).astype(np.int64), np.stack([begin, begin + pairs], 1).ravel())[1::2]
        known = ours * hits / (np.diff(begin, append=len(rows)) - pairs)
        return np.maximum(score - score.max(axis=1, keepdims=True), -CLIP), ours, known.astype(np.float32)


class Scored(dict):
    """Row of ``table`` with the scores of each word seen so far, and of ``ours`` and ``known``."""

    WORDS = 300_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table, self.ours, self.known = model.scores([])

    def add(self, words: set[str]) -> None:
        """Past WORDS words it starts anew, with these."""
        if len(self) > self.WORDS:
            self.clear()
            self.table, self.ours, self.known = self.table[:0], self.ours[:0], self.known[:0]
        new = [w for w in words if w not in self]
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        table, ours, known = self.model.scores(new)
        self.table, self.ours, self.known = np.concatenate([self.table, table]), np.concatenate([self.ours, ours]), np.concatenate([self.known, known])


def viterbi(emit: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; documents lie one after another in ``emit``.

    All documents advance together, longest first, so that a step costs a few
    vector operations however many documents are in it.
    """
    n, size = emit.shape
    labels = np.zeros(n, np.int16)
    if not n:
        return labels
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    stays = np.zeros((n, size), bool)  # whether the best way into this state came from the same state
    source = np.zeros(n, np.int16)  # else it came from this one
    state = np.zeros((len(lengths), size), np.float32)
    active = int(np.count_nonzero(lengths > 0))
    state[:active] = emit[starts[:active]]
    for t in range(1, lengths[0]):
        k = int(np.searchsorted(-lengths, -t, "left"))  # documents of more than t words
        at = starts[:k] + t
        now = state[:k]
        top = now.argmax(axis=1)
        jump = now[np.arange(k), top] - switch
        keep = now >= jump[:, None]
        stays[at] = keep
        source[at] = top
        state[:k] = np.where(keep, now, jump[:, None]) + emit[at]
    last = state.argmax(axis=1).astype(np.int16)
    current = last[:active]
    for t in range(lengths[0] - 1, -1, -1):
        k = int(np.searchsorted(-lengths, -t, "left"))
        at = starts[:k] + t
        labels[at] = current[:k]
        if t:
            keep = stays[at, current[:k]]
            current[:k] = np.where(keep, current[:k], source[at])
    return labels


def predict(texts: list[str | None], model: Model, scored: Scored | None = None, spans: bool = True) -> list[tuple[str, float, list[dict]]]:
    """(language, share of the letters labelled with it, spans) of each text."""
    return [x[:3] for x in _judged(texts, model, scored, spans)]


def _judged(texts: list[str | None], model: Model, scored: Scored | None = None, spans: bool = True) -> list[tuple[str, float, list[dict], float, float]]:
    """As ``predict``, and the share of the letters that the language has in learned scripts, and of those in learned n-grams (by words)."""
    scored = Scored(model) if scored is None else scored
    words: list[str] = []
    lengths = []
    for text in texts:
        own = _WORD.findall(text) if text and model.langs else []
        words += map(str.lower, own)
        lengths.append(len(own))
    scored.add(set(words))
    rows = np.fromiter(map(scored.__getitem__, words), np.int64, len(words))
    letters = np.fromiter(map(len, words), np.int64, len(words))
    size = max(1, len(model.langs))
    ours, known = scored.ours[rows], scored.known[rows]
    labels = viterbi(scored.table[rows], np.array(lengths, np.int64))
    out, at = [], 0
    for text, n in zip(texts, lengths, strict=True):
        own, weight, of = labels[at : at + n], letters[at : at + n], slice(at, at + n)
        at += n
        if not n:
            out.append((UNKNOWN, 0.0, [], 0.0, 0.0))
            continue
        share = np.bincount(own, weights=weight, minlength=size)
        best = int(np.argmax(share))
        found = []
        if spans:
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            place = [m.span() for m in _WORD.finditer(text)]
            end = np.concatenate([cut[1:], [n]]) - 1
            found = [{"begin": place[b][0], "end": place[e][1], "lang": model.langs[own[b]]} for b, e in zip(cut, end, strict=True)]
        total = float(share.sum())
        held = float(weight[(own == best) & ours[of]].sum()) / total
        out.append((model.langs[best], float(share[best]) / total, found, held, float(weight @ known[of]) / total))
    return out


#: Documents and characters that take part in one Viterbi run.
GROUP_DOCS, GROUP_CHARS = 1000, 4_000_000


def _groups(batch: pd.DataFrame):
    begin, size = 0, 0
    for k, text in enumerate(batch["text"]):
        n = len(text) if text else 0
        if k > begin and (k - begin >= GROUP_DOCS or size + n > GROUP_CHARS):
            yield batch.iloc[begin:k]
            begin, size = k, 0
        size += n
    if begin < len(batch):
        yield batch.iloc[begin:]


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``train_rows`` rows that are not held out and have text and lang."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = bounded_sample(rows.select("doc_id", "text", "lang"), "doc_id", train_rows)
    return Model([(r.text, r.lang) for r in rows.select("text", "lang").toLocalIterator()])


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every document's whole text.

    ``spans``: false leaves that column empty, which is faster.
    ``und`` and score 0 for null text and text without a letter, and for every
    text if the model has learned no language.  Words in a script that no
    learned language uses count for none (ties go to the first language by
    name).  Repeated rows each get a row; a null doc_id has held_out null;
    extra columns are ignored; an empty table gives an empty table.
    """
    shared = ship(docs.sparkSession, model)

    def run(batches):
        model = shared()
        scored = Scored(model)
        for batch in batches:
            for part in _groups(batch):
                found = predict(list(part["text"]), model, scored, spans)
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": [x[2] for x in found]})

    rows = docs.select(id_text("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return id_number(rows.mapInPandas(run, OUTPUT), "doc_id")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.0, min_known: float = 0.0) -> DataFrame:
    """The documents with an identified language, all columns as they came.

    Rejects text that is null or has no letter, documents whose language holds
    less than ``min_score`` of the letters (those in scripts that no learned
    language uses are held by none), and documents of whose n-grams (3 and 4
    letters, weighted by the words' letters) less than ``min_known`` occur in
    any learned language.  Arrow batches are filtered
    as they are: nulls, large ids and nested columns pass unchanged.
    """
    shared = ship(docs.sparkSession, model)

    def run(batches):
        model = shared()
        scored = Scored(model)
        for batch in batches:
            keep = []
            for part in _groups(pd.DataFrame({"text": batch.column("text").to_pylist()}, dtype=object)):
                found = _judged(list(part["text"]), model, scored, spans=False)
                keep += [lang != UNKNOWN and held >= min_score and known >= min_known for lang, _, _, held, known in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
