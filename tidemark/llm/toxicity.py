"""Toxicity by a noisy channel: words written in leetspeak, spaced out or with repeated letters are decoded by Viterbi
under a letter model counted over the whole corpus; the restored words are then scored with evidence learnt from labels.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.io import free_name
from tidemark.llm.words import distinct_words, slices, texts_of

#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "#": "h"}
FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys")
#: Punctuation removed at the edges of a word. Of it, EDGE_LEET may also be a letter; both readings are tried.
EDGE = ".,;:?\"'()[]{}*&%#`~_-/\\<>=!"
EDGE_LEET = "".join(c for c in EDGE if c in LEET)
#: The same symbols where they must be letters: codes that ASCII words leave free.
AS_LETTER = {ord(c): chr(128 + i) for i, c in enumerate(EDGE_LEET)}
SUSPECT = re.compile(r"(?=.*[a-z])(?:.*[a-z][^a-z]+[a-z]|.*([a-z])\1\1|[0-9@$|+!(]|.*[0-9@$|+]$)")
LETTERS = re.compile(r"[a-z]+")
REPEATED = re.compile(r"(.)\1+")
START = 26
#: Prefix lengths whose evidence counts beside the whole word, so that inflected forms share a stem.
PREFIXES = (4, 5, 6)
LOWEST_PRECISION, CHANCE, BASE_SCORE = 0.9, 0.01, 0.02
#: Word boundaries in a run of spaced letters: log probability of an unknown word and of each of its letters.
UNKNOWN_WORD, UNKNOWN_LETTER, LONGEST_WORD = math.log(1e-3), -math.log(26), 24


def folded(words: list[str]) -> list[str]:
    """Lower case, accents folded, punctuation at the edges removed."""
    return [w.strip(EDGE) for w in "\n".join(words).lower().translate(FOLD).split("\n")] if words else []


def squeezed(word: str) -> str:
    """The word with repeated characters once."""
    return REPEATED.sub(r"\1", word)


def edge_readings(words: list[str]) -> list[tuple[int, str]]:
    """(index of the word, the word with some edge symbols as letters) for ASCII words with EDGE_LEET beside the core.

    Read as letters are none, the nearest or all symbols of the stretch at either edge, but not none at both.
    """
    out = []
    for i, w in enumerate("\n".join(words).lower().translate(FOLD).split("\n") if words else []):
        if not w or w[0] not in EDGE and w[-1] not in EDGE or not w.isascii():
            continue
        core = w.strip(EDGE)
        if not core:
            continue
        before, _, after = w.partition(core)
        heads = before[len(before.rstrip(EDGE_LEET)) :]
        tails = after[: len(after) - len(after.lstrip(EDGE_LEET))]
        kept = {(a, b) for a in ("", heads[-1:], heads) for b in ("", tails[:1], tails)} - {("", "")}
        out += [(i, a.translate(AS_LETTER) + core + b.translate(AS_LETTER)) for a, b in sorted(kept) if len(a + core + b) >= 3]
    return out


@dataclass
class Channel:
    """Emission, deletion and letter-pair log probabilities. A state is the last letter restored, START at first."""

    pairs: np.ndarray
    emit: np.ndarray = field(init=False)
    skip: np.ndarray = field(init=False)

    def __post_init__(self):
        none = np.float32(-1e9)
        size = 128 + len(AS_LETTER)
        self.emit, self.skip = np.full((size, 26), none, np.float32), np.full((size, 27), none, np.float32)
        for code in range(128):
            ch = chr(code)
            if "a" <= ch <= "z":
                self.emit[code, code - 97] = math.log(0.9)
                self.skip[code, code - 97] = math.log(0.3)  # a repeated letter
            else:
                self.skip[code] = math.log(1e-7 if ch.isalnum() else 0.005 if ch in LEET else 0.5)
                for stands in LEET.get(ch, ""):
                    self.emit[code, ord(stands) - 97] = math.log(0.4)
        for code, letter in AS_LETTER.items():
            self.emit[ord(letter)] = self.emit[code]

    def decode(self, words: list[str]) -> list[str]:
        """The likeliest letters behind each word of ASCII and AS_LETTER; words of one length advance together."""
        out = [""] * len(words)
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, rows in by_length.items():
            for a in range(0, len(rows), 4000):
                some = rows[a : a + 4000]
                seen = np.frombuffer("".join(words[i] for i in some).encode("latin-1"), np.uint8).reshape(len(some), n)
                for i, w in zip(some, self._same_length(seen)):
                    out[i] = w
        return out

    def _same_length(self, seen: np.ndarray) -> list[str]:
        rows, n = seen.shape
        value = np.full((rows, 27), -1e9, np.float32)
        value[:, START] = 0
        back = np.empty((n, rows, 27), np.uint8)
        for t in range(n):
            step = value[:, :, None] + self.pairs[None, :, :26]
            came = step.argmax(axis=1)
            new = np.take_along_axis(step, came[:, None, :], axis=1)[:, 0] + self.emit[seen[:, t]]
            stay = value + self.skip[seen[:, t]]
            write = new >= stay[:, :26]
            value = stay
            value[:, :26] = np.where(write, new, stay[:, :26])
            back[t] = 255
            back[t, :, :26] = np.where(write, came, 255)
        state = (value + self.pairs[:, START]).argmax(axis=1)
        letters = np.full((rows, n), 32, np.uint8)
        at = np.arange(rows)
        for t in range(n - 1, -1, -1):
            came = back[t, at, state]
            wrote = came != 255
            letters[wrote, t] = state[wrote] + 97
            state = np.where(wrote, came, state)
        return [bytes(x).decode("ascii").replace(" ", "") for x in letters]

    def restore(self, words: list[str]) -> list[str]:
        """Folded words with the suspicious ones decoded. Words without a Latin letter, or in other scripts, stay."""
        plain = folded(words)
        odd = [i for i, w in enumerate(plain) if w.isascii() and not (w.isalpha() and len(w) < 3) and SUSPECT.match(w)]
        for i, w in zip(odd, self.decode([plain[i] for i in odd])):
            plain[i] = w
        return plain


def spaced_words(dictionary: list[str], index: np.ndarray, rows: np.ndarray) -> tuple[list[str], list[int], np.ndarray]:
    """Runs of three or more one-character words, joined, the row of each, and which words stand outside of runs."""
    single = np.array([len(w) == 1 and (w.isalpha() or w in LEET) for w in dictionary] or [False])
    hit = single[index] if len(index) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(hit)
    alone = np.ones(len(index), bool)
    if not len(at):
        return [], [], alone
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
    runs = [x for x in np.split(at, cut) if len(x) >= 3]
    for x in runs:
        alone[x] = False
    return ["".join(dictionary[j] for j in index[x]) for x in runs], [int(row[x[0]]) for x in runs], alone


def _restored(channel: Channel, texts: pa.Array, model: Toxicity | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct restored words, row of each pair, word of each pair), pairs distinct.

    A run of spaced letters counts as one word and, with a model, also as the words it segments into; its letters do
    not count by themselves. With a model, a word whose core is no known word takes the reading of its edge symbols
    that scores best.
    """
    dictionary, index, rows = distinct_words(texts)
    words = dictionary.to_pylist()
    joined, joined_rows, alone = spaced_words(words, index, rows)
    restored = channel.restore(words + joined)
    if model:
        model.reread(words + joined, restored, len(words))
        parts = [model.segment(run) for run in restored[len(words) :]]
        restored += [w for part in parts for w in part]
        joined_rows += [r for r, part in zip(joined_rows, parts) for _ in part]
    names = {w: i for i, w in enumerate(dict.fromkeys(restored))}
    code = np.array([names[w] for w in restored], dtype=np.int64)
    row = np.concatenate((np.repeat(np.arange(len(texts)), np.diff(rows))[alone], np.array(joined_rows, dtype=np.int64)))
    word = np.concatenate((code[index[alone]], code[len(words) :])) if len(code) else np.zeros(0, np.int64)
    pair = np.unique(row * max(1, len(names)) + word)
    return list(names), pair // max(1, len(names)), pair % max(1, len(names))


def features(word: str) -> list[str]:
    """The word and its prefixes, for words of three letters or more."""
    return [word] + [word[:k] + "*" for k in PREFIXES if len(word) >= k] if len(word) >= 3 else []


def count_letter_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after another, counted over every word of every document; 729 counts reach the driver."""

    def run(batches):
        total = np.zeros(27 * 27, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                dictionary, index, _ = distinct_words(texts_of(batch, "text"))
                words = folded(dictionary.to_pylist())
                times = np.bincount(index, minlength=len(words)) if len(index) else np.zeros(0, np.int64)
                clean = [(w, n) for w, n in zip(words, times.tolist()) if w.isascii() and w.isalpha()]
                if not clean:
                    continue
                raw = np.frombuffer(("`" + "`".join(w for w, _ in clean) + "`").encode(), np.uint8).astype(np.int64)
                code = np.where(raw == 96, START, raw - 97)
                weight = np.repeat([n for _, n in clean], [len(w) + 1 for w, _ in clean])
                total += np.bincount(code[:-1] * 27 + code[1:], weights=weight, minlength=729).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(729)), pa.array(total)], names=["pair", "n"])

    counts = np.ones((27, 27))
    for pair, n in docs.selectExpr(f"`{text_col}` as text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair // 27, pair % 27] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


@dataclass
class Toxicity:
    """words holds the number of labelled documents with each plain word; it sets the boundaries in spaced runs."""

    channel: Channel
    evidence: dict[str, float]
    words: dict[str, int] = field(default_factory=dict)
    cost: dict[str, float] = field(init=False)

    def __post_init__(self):
        total = max(1, sum(self.words.values()))
        self.cost = {w: math.log(n / total) for w, n in self.words.items()}
        self.rare = -math.log(total)
        self.whole = "\n".join(squeezed(f) for f in self.evidence if f[-1:] != "*")
        self.stems = [squeezed(f[:-1]) for f in self.evidence if f[-1:] == "*"]

    def word_cost(self, word: str) -> float:
        """Log probability; a word with evidence counts as seen once at least."""
        known = self.cost.get(word)
        if known is None:
            known = self.rare if self.word_score(word) > 0 else UNKNOWN_WORD + len(word) * UNKNOWN_LETTER
        return known

    def segment(self, run: str) -> list[str]:
        """The likeliest words behind each stretch of letters of a joined run."""
        out = []
        for letters in LETTERS.findall(run):
            best, back = [0.0], [0]
            for end in range(1, len(letters) + 1):
                value, start = max((best[a] + self.word_cost(letters[a:end]), a) for a in range(max(0, end - LONGEST_WORD), end))
                best.append(value)
                back.append(start)
            words, end = [], len(letters)
            while end:
                words.append(letters[back[end] : end])
                end = back[end]
            out += reversed(words)
        return out

    def can_tell(self, reading: str) -> bool:
        """Whether the reading of a word can have evidence. Exact for a core of letters; any other core counts as able to.

        Letters are decoded as themselves or, repeated, left out, so the squeezed core stands inside a squeezed word, or
        it overlaps a squeezed stem after as many letters at most as there are symbols before it.
        """
        core = LETTERS.search(reading)
        if not core or not all(ord(c) > 127 for c in reading[: core.start()] + reading[core.end() :]):
            return True
        letters = squeezed(core[0])
        return letters in self.whole or any(letters.startswith(stem[a : a + len(letters)]) for stem in self.stems for a in range(min(core.start() + 1, len(stem))))

    def reread(self, words: list[str], restored: list[str], first_run: int) -> None:
        """Puts a reading with edge symbols as letters in place of the restored word where it scores better.

        From first_run on the words are joined runs, which score as the best word they segment into and in which every
        such symbol stood by itself, so one more reading takes all of them as letters.
        """
        tried = [(i, w) for i, w in edge_readings(words) if restored[i] not in self.words and (i >= first_run or self.can_tell(w))]
        runs = [(i, w.lower().translate(FOLD)) for i, w in enumerate(words[first_run:], first_run)]
        tried += [(i, w.translate(AS_LETTER)) for i, w in runs if w.isascii() and any(c in w for c in EDGE_LEET)]
        for (i, _), letters in zip(tried, self.channel.decode([w for _, w in tried])):
            now, then = (max(map(self.word_score, [x, *(self.segment(x) if i >= first_run else [])])) for x in (restored[i], letters))
            if then > now:
                restored[i] = letters

    def word_score(self, word: str) -> float:
        return max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Noisy-or over the distinct restored words of each text that carry evidence."""
        words, row, word = _restored(self.channel, texts, self)
        clean = np.log1p(-np.array([self.word_score(w) for w in words] or [0.0]))
        total = np.bincount(row, weights=clean[word], minlength=len(texts)) if len(row) else np.zeros(len(texts))
        return np.clip(1 - (1 - BASE_SCORE) * np.exp(total), 0.0, 1.0)


def _narrowest(evidence: dict[str, float], toxic: dict[str, int]) -> dict[str, float]:
    """Evidence without the prefixes of which a longer prefix or a whole word has nearly all toxic documents."""
    longer: dict[str, int] = {}
    for f, n in toxic.items():
        stem = f.rstrip("*")
        for k in PREFIXES:
            if len(stem) > k or len(stem) == k and f == stem:
                longer[stem[:k] + "*"] = max(n, longer.get(stem[:k] + "*", 0))
    return {f: p for f, p in evidence.items() if longer.get(f, 0) < 0.95 * toxic[f]}


def fit(docs: DataFrame, labels: DataFrame, most_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Learns the channel from all documents and the evidence from at most about most_train labelled ones.

    Labelled rows are those with a label whose crc32(id) mod 5 is not 0; beyond most_train, a share of them by a hash
    of the id. A word or prefix is evidence when its share of toxic documents is at least LOWEST_PRECISION and too high
    for chance after a correction for the number of words tried (Chernoff bound). Without labels there is no evidence.
    In training a run of spaced letters counts as one word; its boundaries are only decoded when texts are scored.
    """
    channel = Channel(count_letter_pairs(docs, text_col))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_train / n))
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words, row, word = _restored(channel, texts_of(batch, "text"))
                toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
                count: dict[str, list[int]] = {"": [int((toxic == 1).sum()), int((toxic != 1).sum())]}
                own = [features(w) or ([w] if LETTERS.fullmatch(w) else []) for w in words]
                seen: set[str] = set()
                last = -1
                for r, w in zip(row.tolist(), word.tolist()):
                    if r != last:
                        seen, last = set(), r
                    for f in own[w]:
                        if f not in seen:
                            seen.add(f)
                            count.setdefault(f, [0, 0])[0 if toxic[r] == 1 else 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array([x[0] for x in count.values()], pa.int64()), pa.array([x[1] for x in count.values()], pa.int64())], names=["feature", "toxic", "clean"])

    counted = sample.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.lit(1).alias("one"))
    telling = (F.length("feature") >= 3) & (F.col("toxic") >= 3) & (F.col("toxic") >= LOWEST_PRECISION * (F.col("toxic") + F.col("clean")))
    plain = (F.col("toxic") + F.col("clean") >= 3) & F.col("feature").rlike(f"^[a-z]{{1,{LONGEST_WORD}}}$")
    rows = counted.withColumns({"telling": (F.col("feature") == "") | telling, "plain": plain}).where("telling or plain").collect()
    found = [r for r in rows if r.telling]
    words = {r.feature: r.toxic + r.clean for r in rows if r.plain}
    sizes = next(((r.toxic, r.clean) for r in found if r.feature == ""), (0, 0))
    if not sizes[0]:
        return Toxicity(channel, {}, words)
    base = min(0.5, sizes[0] / sum(sizes))
    evidence = {}
    bar = math.log(len(found) * 100 / CHANCE)
    for r in found:
        total = r.toxic + r.clean
        share = min(r.toxic / total, 1 - 1e-9)
        information = total * (share * math.log(share / base) + (1 - share) * math.log((1 - share) / (1 - base)))
        if r.feature and information > bar and (r.toxic + 1) / (total + 2) >= LOWEST_PRECISION:
            evidence[r.feature] = (r.toxic + 1) / (total + 2)
    return Toxicity(channel, _narrowest(evidence, {r.feature: r.toxic for r in found}), words)


def score_documents(docs: DataFrame, model: Toxicity, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with a score 0..1 as the last column; null and empty texts have BASE_SCORE, and rows, order and columns stay.

    A column that has the score's name already gives way to it. Repeated rows score alike; an empty table stays empty.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts_of(batch, text_col)))], names=[*batch.schema.names, score_col])

    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    return docs.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Rows without an id are not held out and score like others; null and empty texts have BASE_SCORE; repeated rows score
    alike; an empty table gives no rows; other columns are ignored. Without labels all scores are BASE_SCORE.
    """
    model = fit(docs, labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score_documents(docs.select("doc_id", "text"), model, score_col="score").select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those scored at or above threshold. Columns of any name, rows without an id or text, and repeats stay.

    An empty table stays empty, and without labels nothing goes.
    """
    name = free_name(docs, "toxicity")
    scored = score_documents(docs, fit(docs, labels), score_col=name)
    return scored.where(F.col(name) < threshold).drop(name)
