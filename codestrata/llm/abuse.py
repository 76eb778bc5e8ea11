"""Scores for abusive, hateful or sexual language by multiple-instance learning.

Reviewers label documents, not sentences. A linear model scores each sentence; the scores of a
document's sentences are combined by noisy-or and the model is fitted so that the combination
explains the labels, with the reviewers' error rate as part of the likelihood. Sentence scores then
locate what offends.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.tables import folded

#: Labelled documents a model is fitted on at most, picked by a hash of the id, the bytes of their texts together, and of one text.
TRAIN_DOCUMENTS = 25_000
TRAIN_BYTES = 128 << 20
TRAIN_TEXT_BYTES = 1 << 20
THRESHOLD = 0.5
STEPS = 100
PENALTY = 2e-5
#: The logit of a document's only sentence, of which nothing is known.
BIAS = -3.0
#: What a sentence's logit loses by the log of the number of sentences beside it; at 1 a document of harmless sentences scores the same whatever its length.
LENGTH = 1.0
FOLDS = 5
#: Sentences, with their characters, and words up to a length that a scoring task remembers; bounds memory only.
KNOWN_SENTENCES = 50_000
KNOWN_CHARACTERS = 8_000_000
KNOWN_WORDS = 100_000
KNOWN_LENGTH = 100

# Letters of other scripts that look like Latin ones, and signs written for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "|": "l"}
_TO_LATIN = str.maketrans(_LOOKALIKES)
_TO_CYRILLIC = str.maketrans({latin: other for other, latin in reversed(_LOOKALIKES.items()) if "Ѐ" <= other <= "ӿ" and other in "авсекмнортух"})
_FROM_SIGNS = str.maketrans(_SIGNS)

_ENDS = re.compile(r"([.!?…][)\"'”’»]?)[ \t ]+|[\r\n\v\f\u0085  ]+|([。！？؟])")
_INVISIBLE = regex.compile(r"[\p{Cf}︀-️͏]+")
_MARKS = regex.compile(r"[̀-ͯ]+")
_LEAD = regex.compile(r"^\s*(?:\[\d{1,2}:\d\d\]\s*)?(?:@\w+:\s*)?(?:[>*|#/+\-]+\s*)*")
_CODE = regex.compile(
    r"(?P<path>(?<![\w.\-])[\w.\-]*(?:/[\w.\-]+)+)"
    r"|(?P<name>(?<!\w)\(?\*?\w+\)?(?:::|\.)\w{3,}(?=\W|$)(?<=\w[a-z_A-Z0-9]{2})(?:\(\))?|\b_*[A-Za-z]{2,}\d*_\w+|\b[a-z]{3,}[A-Z][a-z]{2,}\w*|\b(?:[A-Z][a-z]{2,}){2,}\w*)"
    r"|(?P<user>(?<!\w)@[\p{L}\p{N}_]+)"
    r"|(?P<hash>\b(?=[0-9a-f]*\d)[0-9a-f]{7,}\b)"
    r"|(?P<num>(?<![\p{L}\p{N}@$!*#%])\d+(?:[.,:]\d+)*(?![\p{L}\p{N}@$!]))"
)
_PIECE = regex.compile(r"<\w+>|[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}<>])[^\s,;:.?!()\[\]{}\"“”„«»、，。：；…=~`^/\\]|[!.:](?=\p{L}))+")
_SPELLED = regex.compile(r"^\p{L}(?:[.\-_*·+|]\p{L}){2,}$")
_REPEATED = regex.compile(r"(\p{L})\1{2,}")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_LETTER = regex.compile(r"\p{L}")
_MASK = regex.compile(r"(?<=\p{L})[*#%&]+|[*#%&]+(?=\p{L})")


def split_sentences(text: str) -> list[str]:
    """Parts of a text that end at marks of the end, which stay with them, or at line ends."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        out.append(text[at : m.end(m.lastindex) if m.lastindex else m.start()])
        at = m.end()
    out.append(text[at:])
    return [s for s in out if s and not s.isspace()]


def _plain(text: str) -> str:
    """Compatibility forms, without invisible characters and accents."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text)))


def _word(raw: str, cyrillic: bool) -> str:
    """A word without disguise: one script, no spelling out, no signs for letters, no stretching."""
    word = raw
    if not word.isascii():
        latin = any("a" <= c <= "z" for c in word)
        other = any("Ͱ" <= c <= "ԯ" for c in word)
        if other and (latin or not cyrillic):
            moved = word.translate(_TO_CYRILLIC if cyrillic else _TO_LATIN)
            if latin or moved.isascii():
                word = moved
    if _SPELLED.match(word):
        word = "".join(_LETTER.findall(word))
    if not word.isalpha() and _LETTER.search(word):
        word = word.translate(_FROM_SIGNS)
        word = _MASK.sub("*", word)
        word = word.strip("'’-_.*" if word.strip("'’-_.").count("*") == 0 else "'’-_.")
    return _REPEATED.sub(r"\1", word)


def _pieces(token: str) -> list[str]:
    """The parts of what stands between blanks, in lower case, with placeholders for code names, paths, users and numbers."""
    bare = token if token[-1].isalpha() else token[:-1]
    if not (bare.isalpha() and (bare.islower() or bare[1:].islower())):
        token = _CODE.sub(lambda m: f" <{m.lastgroup}> ", token)
    return _PIECE.findall(token.lower())


def _is_single(piece: str) -> bool:
    return len(piece) == 1 and piece.isalpha() and not "\u3000" <= piece <= "\u9fff"


def _token(token: str, cyrillic: bool) -> tuple[str, ...]:
    """The parts of what is between blanks, as words; after an empty mark and as they are if a letter stands alone among them."""
    token = _plain(token)
    pieces = _pieces(token) if token else []
    if any(map(_is_single, pieces)):
        return ("", *pieces)
    return tuple(w for p in pieces if (w := p if p[0] == "<" else _word(p, cyrillic)))


@lru_cache(maxsize=KNOWN_WORDS)
def _latin_token(token: str) -> tuple[str, ...]:
    return _token(token, False)


@lru_cache(maxsize=KNOWN_WORDS)
def _cyrillic_token(token: str) -> tuple[str, ...]:
    return _token(token, True)


def words_of(sentence: str) -> tuple[str, ...]:
    """The words of a sentence without disguise and with placeholders; letters that stand alone in a row are one word."""
    text = sentence if sentence[:1].isalnum() else _LEAD.sub("", _plain(sentence), count=1)
    cyrillic = False
    if not text.isascii() and (other := len(_CYRILLIC.findall(text))):
        cyrillic = 2 * other > sum(map(str.isalpha, text))
    tokens, known = text.split(), _cyrillic_token if cyrillic else _latin_token
    parts = [known(t) if len(t) <= KNOWN_LENGTH else _token(t, cyrillic) for t in tokens] if len(text) > KNOWN_LENGTH else list(map(known, tokens))
    words = tuple(chain.from_iterable(parts))
    return _joined(parts, cyrillic) if "" in words else words


def _joined(parts: list[tuple[str, ...]], cyrillic: bool) -> tuple[str, ...]:
    """Words of parts among which letters stand alone."""
    words: list[str] = []
    single: list[str] = []
    for own in [*parts, ("<",)]:
        raw = own[:1] == ("",)
        for piece in own[raw:]:
            if (raw and _is_single(piece)) or (single and piece in ("@", "$", "0", "1", "3", "4", "5")):
                single.append(piece)
                continue
            if single:
                words += [_word("".join(single), cyrillic)] if len(single) >= 3 else single
                single = []
            words.append(_word(piece, cyrillic) if raw and piece[0] != "<" else piece)
    return tuple(w for w in words[:-1] if w)


def word_features(word: str) -> list[str]:
    """What a word contributes whatever stands beside it."""
    found = ["w " + word]
    if word[0] == "<" or len(word) < 3:
        return found
    framed = f"^{word}$"
    found += ["c " + framed[i : i + n] for n in (3, 4, 5) for i in range(len(framed) - n + 1)]
    if len(word) >= 4:
        found.append(f"a {word[0]}{''.join(sorted(word[1:-1]))}{word[-1]}")
        found.append(f"e {''.join(sorted(word))}")
    if "*" in word[1:] or word[0] == "*":
        found += ["m", f"m {word[0]}{word[-1]}"]
    return found


def numbered(names: set[str]) -> np.ndarray:
    """Features as 32-bit numbers, each once; two of some million rarely share one."""
    return np.unique(np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names], np.uint32))


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """A 32-bit number for a kind of feature and the numbers of its words."""
    x = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for part in parts:
        x = (x ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


class Words:
    """Words by number, with what each contributes whatever stands beside it."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.features: list[np.ndarray] = []
        self.codes: list[int] = []
        self.ends = self._add("^"), self._add("$")

    def _add(self, word: str) -> int:
        self.features.append(numbered(set(word_features(word))))
        self.codes.append(zlib.crc32(("x " + word).encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 % 2**64)
        return self.number.setdefault(word, len(self.number))

    def of(self, words: tuple[str, ...]) -> list[int]:
        known = self.number
        return [known[w] if w in known else self._add(w) for w in words]

    def contexts(self, sentences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of two to four words, with the ends of the sentence, and pairs around one or two words: sentence and feature.

        Computed for all sentences at once over one array of word numbers, windows that cross an end left out.
        """
        begin, end = self.ends
        flat = np.fromiter((n for s in sentences for n in (begin, *s, end)), np.int64)
        owner = np.repeat(np.arange(len(sentences), dtype=np.int32), [len(s) + 2 for s in sentences])
        code = np.array(self.codes, np.uint64)[flat]
        owners, numbers = [], []
        for kind, places in enumerate(((0, 1), (0, 1, 2), (0, 2), (0, 1, 2, 3), (0, 3)), 1):
            last = places[-1]
            if len(flat) <= last:
                continue
            at = np.flatnonzero(owner[last:] == owner[:-last])
            owners.append(owner[at])
            numbers.append(_mixed(kind, *[code[at + p] for p in places]))
        return (np.concatenate(owners), np.concatenate(numbers)) if owners else (np.zeros(0, np.int32), np.zeros(0, np.uint32))


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class Model:
    """Weights by the number of a feature, the bias of a sentence, and what the length of its document takes from it."""

    def __init__(self, weights: dict[int, float], bias: float = BIAS, length: float = LENGTH) -> None:
        self.weights, self.bias, self.length = weights, bias, length
        order = sorted(weights)
        self._names = np.array(order or [0], np.uint32)
        self._values = np.array([weights[n] for n in order] or [0.0])
        self._forget()

    def _forget(self) -> None:
        self._words, self._totals, self._sentences, self._held = Words(), [], {}, 0

    def dumps(self) -> str:
        return json.dumps({"bias": self.bias, "length": self.length, "weights": self.weights})

    @classmethod
    def loads(cls, text: str) -> Model:
        made = json.loads(text)
        return cls({int(n): w for n, w in made["weights"].items()}, made["bias"], made["length"])

    def _of(self, numbers: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._names, numbers), len(self._names) - 1)
        return np.where(self._names[at] == numbers, self._values[at], 0.0)

    def evidence(self, sentences: list[tuple[str, ...]]) -> np.ndarray:
        """What the words of sentences say, a number for each; sentences that are known are not computed again."""
        known = self._sentences
        new = list(dict.fromkeys(s for s in sentences if s not in known))
        if len(known) + len(new) > KNOWN_SENTENCES or self._held > KNOWN_CHARACTERS:
            self._forget()
            known = self._sentences
            new = list(dict.fromkeys(sentences))
        if new:
            words, totals = self._words, self._totals
            self._held += sum(sum(map(len, s)) for s in new)
            numbers = [words.of(s) for s in new]
            totals += [(float(self._of(f).sum()), len(f)) for f in words.features[len(totals) :]]
            total, size = np.array([[sum(x) for x in zip(*(totals[n] for n in set(s)), strict=True)] or [0.0, 0] for s in numbers]).T
            owner, found = words.contexts(numbers)
            total = total + np.bincount(owner, weights=self._of(found), minlength=len(new))
            size = size + np.bincount(owner, minlength=len(new))
            known.update(zip(new, (total / np.sqrt(np.maximum(1, size))).tolist(), strict=True))
        return np.array([known[s] for s in sentences])

    def documents(self, texts: list[str | None]) -> list[tuple[float, int, float, str | None]]:
        """The score of each document, and the place, score and text of its worst sentence (-1, 0 and None if it has none).

        A sentence that a document repeats counts once. The more sentences, the less one of them is
        suspected beforehand, so that many harmless ones don't add up.
        """
        bags = []
        for text in texts:
            bag: dict[tuple[str, ...], tuple[int, str]] = {}
            for i, sentence in enumerate(split_sentences(text or "")):
                bag.setdefault(words_of(sentence), (i, sentence))
            bag.pop((), None)
            bags.append(bag)
        evidence = self.evidence([s for bag in bags for s in bag])
        out, at = [], 0
        for bag in bags:
            if not bag:
                out.append((0.0, -1, 0.0, None))
                continue
            p = probability(self.bias + evidence[at : at + len(bag)] - self.length * np.log(len(bag)))
            at += len(bag)
            worst = int(p.argmax())
            place, sentence = list(bag.values())[worst]
            out.append((float(-np.expm1(np.log1p(-p).sum())), place, float(p[worst]), sentence))
        return out

    def document(self, text: str | None) -> tuple[float, int, float]:
        return self.documents([text])[0][:3]


def reviewer_error(votes_for: np.ndarray, votes_against: np.ndarray) -> float:
    """The rate at which a reviewer errs, from how often two opinions on one document differ."""
    pairs = votes_for + votes_against
    several = pairs >= 2
    differ = float((2 * votes_for * votes_against / np.maximum(pairs * (pairs - 1), 1))[several].sum())
    rate = (differ + 1) / (int(several.sum()) + 20)
    return float(np.clip((1 - np.sqrt(max(0.0, 1 - 2 * rate))) / 2, 0.01, 0.2))


class _Bags:
    """Sentences of the training documents as sparse rows, each distinct sentence once.

    Features that occur in exactly the same sentences have the same weight at every step, so they are kept as one column that counts several times.
    """

    def __init__(self) -> None:
        self._sentence_no: dict[tuple[str, ...], int] = {}
        self._bags: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        bag = {w for s in split_sentences(text or "") if (w := words_of(s))}
        self._bags.append(np.array(sorted(self._sentence_no.setdefault(w, len(self._sentence_no)) for w in bag), np.int64))

    def close(self) -> _Bags:
        """Number the features of all sentences, once all documents are added."""
        words = Words()
        numbers = [words.of(s) for s in self._sentence_no]
        self.size, self.count = len(numbers), len(self._bags)
        self._sentence_no = {}
        owner, index = words.contexts(numbers)
        distinct = [sorted(set(s)) for s in numbers]
        own = np.repeat(np.arange(self.size, dtype=np.int32), [sum(len(words.features[n]) for n in s) for s in distinct])
        owner, index = np.concatenate([own, owner]), np.concatenate([*[words.features[n] for s in distinct for n in s], index]).astype(np.uint32)
        self.scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=self.size)))
        names, index = np.unique(index, return_inverse=True)
        order = np.lexsort((owner, index))
        index, owner = index[order], owner[order]
        starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]]) if len(index) else np.zeros(0, np.int64)
        marks = np.random.default_rng(0).integers(1, 2**63, max(1, self.size), np.uint64)
        sums = np.add.reduceat(marks[owner], starts) if len(starts) else np.zeros(0, np.uint64)
        often = np.diff(np.r_[starts, len(index)]) >= 2
        _, first, group = np.unique(sums[often], return_index=True, return_inverse=True)
        self.names, self.group = names[often], group
        self.times = np.bincount(group, minlength=len(first)).astype(float)
        kept = np.full(len(names), -1, np.int64)
        kept[np.flatnonzero(often)[first]] = np.arange(len(first))
        column = kept[index]
        self._column, self._row = column[column >= 0].astype(np.int32), owner[column >= 0]
        order = np.argsort(self._column, kind="stable")
        self._column, self._row = self._column[order], self._row[order]
        self._column_starts = np.searchsorted(self._column, np.arange(len(first)))
        by_row = np.argsort(self._row, kind="stable")
        self._row_columns = self._column[by_row]
        self._rows, self._row_starts = np.unique(self._row[by_row], return_index=True)
        self.docs = np.concatenate(self._bags) if self._bags else np.zeros(0, np.int64)
        lengths = np.array([len(b) for b in self._bags], np.int64)
        self.doc_of = np.repeat(np.arange(self.count), lengths)
        self.log_length = np.log(np.maximum(1, lengths))[self.doc_of]
        return self

    def totals(self, weight: np.ndarray, bias: float, length: float) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each sentence in each document, and minus the log of the probability that a document is clean."""
        evidence = np.zeros(self.size)
        if len(self._rows):
            evidence[self._rows] = np.add.reduceat((weight * self.times)[self._row_columns], self._row_starts)
        z = (bias + self.scale * evidence)[self.docs] - length * self.log_length
        return z, np.bincount(self.doc_of, weights=np.logaddexp(0, z), minlength=self.count)

    def optimise(self, yes: np.ndarray, no: np.ndarray, steps: int, penalty: float, length: float) -> np.ndarray:
        """Weights of the columns that maximise the mean of log(P yes + (1 - P) no), less the penalty."""
        weight = np.zeros(len(self.times))
        m, v = np.zeros_like(weight), np.zeros_like(weight)
        n_docs = int((yes != no).sum()) or 1
        for step in range(1, steps + 1):
            z, total = self.totals(weight, BIAS, length)
            clean = np.exp(-total)
            slope = -(yes - no) * clean / np.maximum((1 - clean) * yes + clean * no, 1e-12)
            per_sentence = np.bincount(self.docs, weights=slope[self.doc_of] * probability(z), minlength=self.size)
            gradient = np.add.reduceat((per_sentence * self.scale)[self._row], self._column_starts) / n_docs + penalty * weight / np.sqrt(n_docs)
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            rate = 0.15 * min(1.0, 3 * (steps + 1 - step) / steps)
            weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return weight


def fit(texts: Iterable[str | None], votes_for: np.ndarray, votes_against: np.ndarray, steps: int = STEPS, penalty: float = PENALTY, length: float = LENGTH) -> Model:
    """Fit sentence weights so that the noisy-or of each document explains its reviewers' opinions.

    Reviewers err at a rate that their disagreements show. A first pass fits on all folds but one
    and asks what the rest looks like to it; the second fits on what an opinion and that view
    together make likely, so that a wrong opinion on a harmless document isn't learned by heart.
    """
    bags = _Bags()
    for text in texts:
        bags.add(text)
    return fit_bags(bags.close(), votes_for, votes_against, steps, penalty, length)


def fit_bags(bags: _Bags, votes_for: np.ndarray, votes_against: np.ndarray, steps: int = STEPS, penalty: float = PENALTY, length: float = LENGTH) -> Model:
    if not len(bags.times):
        return Model({}, BIAS, length)
    error = reviewer_error(votes_for, votes_against)
    yes = (1 - error) ** votes_for * error**votes_against
    no = error**votes_for * (1 - error) ** votes_against
    fold = np.arange(bags.count) % FOLDS
    seen = np.zeros(bags.count)
    for k in range(FOLDS):
        weight = bags.optimise(np.where(fold == k, 1.0, yes), np.where(fold == k, 1.0, no), steps // 2, penalty, length)
        seen[fold == k] = 1 - np.exp(-bags.totals(weight, BIAS, length)[1][fold == k])
    seen = np.clip(seen, 0.08, 0.97)
    likely = seen * yes / (seen * yes + (1 - seen) * no)
    weight = bags.optimise(likely, 1 - likely, steps, penalty, length)[bags.group]
    return Model({int(n): round(float(w), 4) for n, w in zip(bags.names, weight, strict=True) if abs(w) >= 0.01}, BIAS, length)


def votes(labels: DataFrame, doc: str, reviewer: str, label: str, at: str) -> DataFrame:
    """Opinions for and against per document; each reviewer's latest on a document counts.

    Letter case and outer blanks of a label carry no meaning; other labels, NULLs and rows without a document don't count.
    """
    rows = labels.select(F.col(doc).alias("doc"), F.col(reviewer).alias("reviewer"), folded(label).alias("label"), F.col(at).alias("at")).where(F.col("doc").isNotNull() & F.col("label").isin("abusive", "ok"))
    last = rows.groupBy("doc", "reviewer").agg(F.max(F.struct("at", "label")).alias("held"))
    return last.groupBy("doc").agg(F.count_if(F.col("held.label") == "abusive").alias("votes_for"), F.count_if(F.col("held.label") == "ok").alias("votes_against"))


def train(documents: DataFrame, opinions: DataFrame, doc: str, text: str, most: int = TRAIN_DOCUMENTS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model fitted by one task on a sample of labelled documents, which a hash of the id picks.

    The sample has about ``most`` documents, at most that many, none with a text over ``TRAIN_TEXT_BYTES``, and of
    ``most_bytes`` together; the hash picks among the opinions, before the join, and the task
    reads texts one batch at a time in the order of the hash, keeping sentences and no texts. Only the weights come to the driver.
    A document without opinions, or whose id is NULL, isn't picked. Without labels the model knows nothing and reports nothing.
    """
    own = F.xxhash64("doc")
    labelled = opinions.count()
    if labelled > most:
        opinions = opinions.where(F.pmod(own, F.lit(1 << 30)) < F.lit(int(most / labelled * (1 << 30))))
    texts = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_TEXT_BYTES)
    picked = texts.join(opinions, "doc").select("doc", "text", "votes_for", "votes_against").repartition(1).sortWithinPartitions(own, "doc", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, votes_for, votes_against, held = _Bags(), [], [], 0
        for batch in batches:
            for t, f, a in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "votes_for", "votes_against")), strict=True):
                held += len(t or "")
                if held <= most_bytes and len(votes_for) < most:
                    bags.add(t)
                    votes_for.append(f)
                    votes_against.append(a)
        made = fit_bags(bags.close(), np.array(votes_for, float), np.array(votes_against, float))
        yield pa.RecordBatch.from_arrays([pa.array([made.dumps()], pa.string())], names=["model"])

    learned = picked.mapInArrow(learn, "model string").first()
    return Model.loads(learned["model"]) if learned else Model({})


def score(documents: DataFrame, doc: str, text: str, model: Model) -> DataFrame:
    """The score of every document and its worst sentence.

    A NULL, empty or blank text scores 0 and has no worst sentence. Repeated rows are scored each. Texts are
    read whole; a map over the rows without a shuffle. Other columns are kept, save any that are named like the result's.

    Result: the columns of ``documents`` without the text, score, sentence_no, sentence_score, sentence.
    """
    result = ("score", "sentence_no", "sentence_score", "sentence")
    kept = [c for c in documents.columns if c != text and c.lower() not in result]
    own = [T.StructField(c, documents.schema[c].dataType) for c in kept]
    schema = T.StructType([*own, T.StructField("score", T.DoubleType()), T.StructField("sentence_no", T.IntegerType()), T.StructField("sentence_score", T.DoubleType()), T.StructField("sentence", T.StringType())])
    shared = documents.sparkSession.sparkContext.broadcast(model.dumps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_here = Model.loads(shared.value)
        types = (pa.float64(), pa.int32(), pa.float64(), pa.string())
        for batch in batches:
            found = model_here.documents(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *result])

    return documents.select(*kept, text).mapInArrow(run, schema)


def is_flagged(threshold: float = THRESHOLD) -> Column:
    """Whether a scored document is reported."""
    return F.col("score") >= threshold


def rates(scored: DataFrame, by: str) -> DataFrame:
    """Documents, flagged documents and their share per value of ``by``; NULL is a value."""
    return scored.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(is_flagged()).alias("flagged"), F.avg(is_flagged().cast("double")).alias("rate"))
