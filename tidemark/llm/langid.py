"""Language identification by unigram models over the pieces of a fixed public vocabulary.

A language is a distribution over the vocabulary's pieces. The probability of a word is the sum over all of its
segmentations into pieces, computed by the forward algorithm; a text's log-likelihood is the sum over its words (white
space never lies inside a piece). The piece probabilities are fitted by expectation-maximisation on word counts: the
forward-backward algorithm gives each piece's expected count, Spark sums them, and the sums, whose number is bounded by
vocabulary times languages, give the next model.

Training reads at most about TRAIN_DOCUMENTS whole texts of each language, chosen by a hash of the id; where a language
has fewer, all of them. Prediction reads every whole text. Words without a letter count for nothing. A null text, or one
without a letter, is `und` with score 0, as is every text where nothing was learned. Labels, ids and sources are not
inputs of a prediction. Ties go to the language that sorts first. Repeated rows get equal answers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import stored

TRAIN_DOCUMENTS = 250
ROUNDS = 2
SMOOTHING = 0.02
SHORT_WORD = 40
CACHED_WORDS = 200_000
GROUP_WORDS = 100_000
UNKNOWN = "und"
WORD_START = "▁"
_FREE = np.uint64((1 << 64) - 1)


class Vocabulary:
    """Piece -> number, for the pieces of a public SentencePiece model; the last number stands for any other character."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.number = {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in ordinary))}
        self.size = len(self.number) + 1
        for p in list(self.number):  # no piece, but the beginning of one
            for n in range(1, len(p)):
                self.number.setdefault(p[:n], -1)
        self._index()

    def _index(self) -> None:
        """The pieces as a tree of prefixes: an open hash table from (node, character) to the next node; node 0 is empty."""
        node = {p: i + 1 for i, p in enumerate(self.number)} | {"": 0}
        self.piece = np.array([-1, *self.number.values()], np.int64)
        self.deepest = max(map(len, self.number), default=0)
        key = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in self.number], np.uint64)
        self.slots = 1 << max(4, (4 * len(key)).bit_length())
        self.keys, self.nodes = np.full(self.slots, _FREE, np.uint64), np.zeros(self.slots, np.int64)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):  # each free place takes one of the keys that want it; the others go on to the next
            free = self.keys[at[todo]] == _FREE
            _, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[at[placed]], self.nodes[at[placed]] = key[placed], placed + 1
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) & (self.slots - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The node behind each node and character; 0 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | character.astype(np.uint64)
        at, out, todo = self._slot(key), np.zeros(len(key), np.int64), np.arange(len(key))
        while len(todo):
            held = self.keys[at]
            same = held == key[todo]
            out[todo[same]] = self.nodes[at[same]]
            on = ~same & (held != _FREE)
            todo, at = todo[on], (at[on] + 1) & (self.slots - 1)
        return out

    def lattice(self, word: str) -> list[tuple[int, int, int]]:
        """The (start, stop, number) of every piece in a word, by start; a character that is no piece is the last number."""
        number, n, found = self.number, len(word), []
        for i in range(n):
            if number.get(word[i], -1) < 0:
                found.append((i, i + 1, self.size - 1))
            for j in range(i + 1, n + 1):
                p = number.get(word[i:j])
                if p is None:
                    break
                if p >= 0:
                    found.append((i, j, p))
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Lower-cases ASCII letters and blanks every other ASCII character.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def spelled(text: str) -> list[bytes]:
    """The words of a text as the models see them: runs of letters and of characters outside ASCII."""
    return text.encode().translate(_LETTERS).split()


def shaped(word: str) -> str:
    """How a word meets the vocabulary: lower case, behind the mark of a word's start; empty if it has no letter."""
    return WORD_START + word.lower() if word.isalpha() or any(map(str.isalpha, word)) else ""


def forward_many(own: Vocabulary, words: list[str], chance: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, all words at once; for words of up to SHORT_WORD characters.

    Position by position, the sums over segmentations that end there flow on along every piece that begins there; the
    pieces are found by walking the tree of prefixes for all words together, longest words first.
    """
    size = np.array([len(w) for w in words], np.int64)
    by = np.argsort(-size, kind="stable")
    size = size[by]
    code = np.frombuffer("".join([words[i] for i in by]).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size  # of each word's characters; its positions are one more
    place = first + np.arange(len(size))
    alpha = np.zeros((len(code) + len(size), chance.shape[1]))
    alpha[place] = 1
    for i in range(int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -i, "left"))  # words longer than i
        here = alpha[place[:active] + i]
        which, node = np.arange(active), np.zeros(active, np.int64)
        for depth in range(1, own.deepest + 1):
            if depth > 1:
                longer = size[which] >= i + depth
                which, node = which[longer], node[longer]
            node = own.step(node, code[first[which] + i + depth - 1])
            piece = own.piece[node]
            if depth == 1:  # a character that is no piece is the last number
                lone = which[piece < 0]
                alpha[place[lone] + i + 1] += here[lone] * chance[-1]
            ends = piece >= 0
            some = which[ends]
            alpha[place[some] + i + depth] += here[some] * chance[piece[ends]]
            on = node > 0
            which, node = which[on], node[on]
            if not len(which):
                break
    out = np.empty((len(size), chance.shape[1]))
    out[by] = np.log(alpha[place + size])
    return out


def forward_long(lattice: list[tuple[int, int, int]], n: int, chance: np.ndarray) -> np.ndarray:
    """The same for one long word, rescaled as it goes; only the last few positions are held."""
    window: dict[int, np.ndarray] = {0: np.ones(chance.shape[1])}
    scale, at = np.zeros(chance.shape[1]), 0
    for i, j, p in lattice:
        if i != at:
            del window[at]
            at = i
            if i % 8 == 0:
                most = np.maximum(window[i], 1e-290)
                scale += np.log(most)
                window = {k: v / most for k, v in window.items()}
        window[j] = window.get(j, 0) + window[i] * chance[p]
    return scale + np.log(np.maximum(window[n], 1e-300))


def expected(lattice: list[tuple[int, int, int]], n: int, chance: np.ndarray) -> list[tuple[int, float]]:
    """Expected number of times each piece of the lattice is used, in one language; positions are rescaled by length."""
    base = float(chance.max())
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    alpha[0] = beta[n] = 1.0
    weight = [(i, j, p, float(chance[p]) / base ** (j - i)) for i, j, p in lattice]
    for i, j, _, c in weight:
        alpha[j] += alpha[i] * c
    for i, j, _, c in reversed(weight):
        beta[i] += beta[j] * c
    total = alpha[n]
    return [(p, alpha[i] * c * beta[j] / total) for i, j, p, c in weight] if 0 < total < float("inf") else []


def _swept(arcs: list[tuple[int, int, float]], n: int) -> tuple[list[float], list[float]]:
    """The summed weight of all paths from 0 to each position over arcs in order of their start, and the logarithm it lacks."""
    value, lacks, reach = [1.0] + [0.0] * n, [0.0] * (n + 1), max(j - i for i, j, _ in arcs)
    at = done = 0
    total = 0.0
    for i, j, c in arcs:
        if i != at:
            at = i
            if i - done >= 8:
                done, most = i, value[i]
                total += math.log(most)
                for k in range(i, min(n, i + reach) + 1):
                    value[k] /= most
            lacks[i] = total
        value[j] += value[i] * c
    lacks[n] = total
    return value, lacks


def expected_long(lattice: list[tuple[int, int, int]], n: int, chance: np.ndarray) -> list[tuple[int, float]]:
    """The same for one long string, rescaled as it goes."""
    arcs = [(i, j, float(chance[p])) for i, j, p in lattice]
    alpha, up = _swept(arcs, n)
    beta, down = _swept(sorted((n - j, n - i, c) for i, j, c in arcs), n)
    whole = up[n] + math.log(alpha[n])
    return [(p, alpha[i] * c * beta[n - j] * math.exp(up[i] + down[n - j] - whole)) for (i, j, c), (_, _, p) in zip(arcs, lattice)]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, word) within a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.update((lang, w) for w in spelled(text.as_py()))
        columns = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1].decode() for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])


@dataclass(frozen=True)
class Model:
    """chance[piece, language]: the probability of a piece."""

    path: str
    languages: tuple[str, ...]
    chance: np.ndarray


def train(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_DOCUMENTS) -> Model:
    """A model of the languages of df's labelled rows."""
    rows = df.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    size = vocabulary(path).size
    chance = np.full((size, len(languages)), 1.0 / size)
    if not languages:
        return Model(path, languages, chance)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, bound / counts[lang])))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counted = stored(chosen.select("lang", "t").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    place = {lang: i for i, lang in enumerate(languages)}

    for _ in range(ROUNDS):
        now = chance

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total = vocabulary(path), {}
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    word = shaped(word)
                    if word:
                        k, counted_in = place[lang], expected if len(word) <= SHORT_WORD else expected_long
                        for p, x in counted_in(own.lattice(word), len(word), now[:, k]):
                            total[k, p] = total.get((k, p), 0.0) + n * x
            columns = [pa.array([k for k, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int32()), pa.array(list(total.values()), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "p", "n"])

        chance = np.zeros_like(now)
        summed = counted.mapInArrow(count, "k int, p int, n double").groupBy("k", "p").agg(F.sum("n").alias("n")).toArrow()
        chance[summed["p"].to_numpy(), summed["k"].to_numpy()] = summed["n"].to_numpy()
        chance = chance / np.maximum(chance.sum(0), 1e-9) * (1 - SMOOTHING) + SMOOTHING / size
    return Model(path, languages, chance)


class Scorer(dict):
    """Word, as UTF-8 -> its row in a table of log-probabilities by language; the last column is 1 where it has a letter."""

    def __init__(self, model: Model) -> None:
        self.model, self.own = model, vocabulary(model.path)
        self.table = np.zeros((1024, len(model.languages) + 1))

    def learn(self, new: list[bytes]) -> None:
        """Give rows to words that have none."""
        first = len(self)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(new)] = 0
        short, spellings = [], []
        for i, word in enumerate(new):
            self[word] = first + i
            text = shaped(word.decode())
            if not text:
                continue
            self.table[first + i, -1] = 1
            if len(text) <= SHORT_WORD:
                short.append(first + i)
                spellings.append(text)
            else:
                self.table[first + i, :-1] = forward_long(self.own.lattice(text), len(text), self.model.chance)
        if short:
            self.table[short, :-1] = forward_many(self.own, spellings, self.model.chance)

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """For each list of words: log-likelihood by language, and the number of words with a letter."""
        every = set().union(*texts)
        new = every.difference(self)
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = every
        self.learn(list(new))
        return np.array([self.table[list(map(self.__getitem__, found))].sum(0) for found in texts])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score, the posterior probability of that language, in place of columns of these names."""
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            total = np.zeros((batch.num_rows, len(model.languages) + 1))
            for rows, found in _grouped(batch.column(at)) if model.languages else ():
                np.add.at(total, rows, scorer.score(found))
            best, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for i in np.flatnonzero(total[:, -1]):
                likely = total[i, :-1]
                k = int(likely.argmax())
                best[i] = model.languages[k]
                score[i] = float(1 / np.exp(np.clip(likely - likely[k], -700, 0)).sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, df.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def _grouped(texts: pa.Array) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows and words of texts, GROUP_WORDS words or so together; a long text is given in several parts."""
    rows, found, size = [], [], 0
    for i, text in enumerate(texts):
        all_words = spelled(text.as_py() or "")
        for at in range(0, len(all_words), GROUP_WORDS):
            rows.append(i)
            found.append(all_words[at : at + GROUP_WORDS])
            size += len(found[-1])
            if size >= GROUP_WORDS:
                yield rows, found
                rows, found, size = [], [], 0
    if rows:
        yield rows, found


_LAST: list[tuple[Model, Scorer]] = []


def _scorer(model: Model) -> Scorer:
    """The scorer of the model that this worker used last, if it is the same one."""
    if not _LAST or not (_LAST[0][0].languages == model.languages and np.array_equal(_LAST[0][0].chance, model.chance)):
        _LAST[:] = [(model, Scorer(model))]
    return _LAST[0][1]


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
