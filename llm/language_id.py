"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the same fixed public vocabulary of pieces. The likelihood of a word is the sum
over all its segmentations into pieces, computed by a forward algorithm; a text's is the product over its words.
Words are whole runs of letters, lower-cased, with the vocabulary's mark in front. A letter that is no piece costs
``UNKNOWN`` in every language. Words of up to ``SHORT_WORD`` letters are summed side by side, longer ones by themselves
with a scaled recurrence, which needs the last states only, as many as the longest piece has letters.

Piece probabilities are learned per language by expectation-maximisation on a bounded, documented sample: at most
``TRAIN_DOCS`` different texts a language, whole. Tasks count the words of these texts, so what meets for a language are
its distinct words. Vocabulary and model are bounded by the vocabulary's size.

Edge cases: a null text or one without letters is ``und`` with score 0, as is every text if nothing could be learned;
rows with a null ``lang`` teach nothing; ties go to the smallest language; repeated rows get equal results and teach
once; a null id is in no held-out fold; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import kernel

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS, ROUNDS, SMOOTH = 400, 4, 0.01
SHORT_WORD, UNKNOWN = 32, 1e-6
MARK = "▁"
CACHE, CHUNK_CHARS = 400_000, 400_000
#: Lengths up to which words share a matrix.
WIDTHS = (4, 8, 12, 18)
#: Short words that are hashed at once, and the least likelihood that is summed without logarithms.
PART_WORDS, LEAST = 2 * CHUNK_CHARS // SHORT_WORD, 1e-280
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
with np.errstate(over="ignore"):
    _UP = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * CHUNK_CHARS, _P, np.uint64))])
    _DOWN = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * CHUNK_CHARS, _INV, np.uint64))])


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of the public vocabulary that lower-cased letters can form, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha()))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _sums(cps: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _UP[: len(cps)])])


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return kernel.mix((sums[end] - sums[start]) * _DOWN[start])


def piece_hashes(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        cps = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        out[i] = _hash(_sums(cps), np.array([0]), np.array([len(cps)]))[0]
    return out


@dataclass
class Lattice:
    """Words as rows of code points (mark first) and the piece at every (start, length): -1 for none, -2 for an
    unknown letter."""

    length: np.ndarray
    pieces: np.ndarray  # words x positions x lengths


def _matrix(cps: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    width = int(length.max(initial=0)) + 1
    m = np.zeros((len(starts), width), np.uint32)
    m[:, 0] = ord(MARK)
    inside = np.arange(width - 1)[None] < length[:, None]
    m[:, 1:][inside] = cps[(starts[:, None] + np.arange(width - 1)[None])[inside]]
    return m


class Segmenter:
    def __init__(self, pieces: list[str]) -> None:
        h = piece_hashes(pieces)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.longest = max((len(p) for p in pieces), default=1)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def lattice(self, cps: np.ndarray, starts: np.ndarray, length: np.ndarray) -> Lattice:
        m = _matrix(cps, starts, length)
        n, width = m.shape
        out = np.full((n, width, min(width, self.longest)), -1, np.int32)
        rows = max(1, CHUNK_CHARS // width)
        for a in range(0, n, rows):
            part = m[a : a + rows]
            sums = _sums(part.ravel())
            row, col = np.divmod(np.arange(part.size), width)
            total = length[a : a + rows] + 1
            for k in range(1, out.shape[2] + 1):
                ok = col + k <= total[row]
                at = np.flatnonzero(ok)
                out[a + row[at], col[at], k - 1] = self.find(_hash(sums, at, at + k))
        single = out[:, :, 0]
        single[(single < 0) & (np.arange(width)[None] <= length[:, None])] = -2
        return Lattice(length + 1, out)

    def pieces(self, word: np.ndarray) -> np.ndarray:
        """The piece at every (position, length) of one word, as in ``Lattice``."""
        cps = np.concatenate([[np.uint32(ord(MARK))], word])
        out = np.full((len(cps), min(len(cps), self.longest)), -1, np.int32)
        for a in range(0, len(cps), CHUNK_CHARS):  # powers reach that far
            part = cps[a : a + CHUNK_CHARS + self.longest]
            sums = _sums(part)
            for k in range(1, out.shape[1] + 1):
                at = np.arange(min(CHUNK_CHARS, len(part) - k + 1))
                out[a + at, k - 1] = self.find(_hash(sums, at, at + k))
        single = out[:, 0]
        single[single < 0] = -2
        return out


def forward(lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """``alpha[word, position, language]``: probability of all segmentations of the first letters.

    ``prob`` has a row for each piece, then one for unknown letters (-2) and one of zeros (-1).
    """
    n, width, longest = lattice.pieces.shape
    alpha = np.zeros((n, width + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, width + 1):
        live = np.flatnonzero(lattice.length >= j)
        for k in range(1, min(j, longest) + 1):
            piece = lattice.pieces[live, j - k, k - 1]
            hit = piece != -1
            if hit.any():
                at = live[hit]
                alpha[at, j] += alpha[at, j - k] * prob[piece[hit]]
    return alpha


def with_specials(prob: np.ndarray) -> np.ndarray:
    k = prob.shape[1]
    return np.concatenate([prob, np.full((1, k), UNKNOWN), np.zeros((1, k))])


def long_word(pieces: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The forward algorithm over one word of any length, in logarithms: (positions + 1) x languages; ``pieces`` are
    positions x lengths."""
    n, longest = pieces.shape
    log = np.zeros((n + 1, prob.shape[1]))
    for j in range(1, n + 1):
        back = np.arange(1, min(j, longest) + 1)
        # the states before, against the last one
        states = np.exp(log[j - back] - log[j - 1])
        log[j] = log[j - 1] + np.log((states * prob[pieces[j - back, back - 1]]).sum(0))
    return log


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of letters."""
    step = np.diff(np.concatenate([[0], _letters()[text].astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends - starts


def words_of(text: str) -> list[str]:
    low = text.lower()
    return [low[s : s + n] for s, n in zip(*(x.tolist() for x in word_spans(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32))), strict=True)]


def learn(texts: list[str], segmenter: Segmenter, n_pieces: int, rounds: int = ROUNDS) -> np.ndarray:
    """``learn_words`` from the words of texts."""
    return learn_words(dict(Counter(w for t in texts for w in words_of(t))), segmenter, n_pieces, rounds)


def learn_words(words: dict[str, int], segmenter: Segmenter, n_pieces: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words and their numbers, by expectation-maximisation over all
    segmentations."""
    prob = np.full(n_pieces, 1 / n_pieces)
    short = sorted((w for w in words if len(w) <= SHORT_WORD), key=lambda w: (len(w), w))
    long = sorted(w for w in words if len(w) > SHORT_WORD)
    for _ in range(rounds if words else 0):
        counts = np.zeros(n_pieces)
        table = with_specials(prob[:, None])
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            weight = np.array([words[w] for w in part], float)
            cps = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            length = np.array([len(w) for w in part])
            lat = segmenter.lattice(cps, np.cumsum(length) - length, length)
            alpha = forward(lat, table)[:, :, 0]
            n, width, longest = lat.pieces.shape
            beta = np.zeros((n, width + 1))
            beta[np.arange(n), lat.length] = 1
            for j in range(width - 1, -1, -1):
                for k in range(1, min(longest, width - j) + 1):
                    piece = lat.pieces[:, j, k - 1]
                    beta[:, j] += np.where(piece != -1, table[piece, 0] * beta[:, j + k], 0)
            total = alpha[np.arange(n), lat.length]
            w, s, k = np.nonzero(lat.pieces >= 0)
            piece = lat.pieces[w, s, k]
            counts += np.bincount(piece, weight[w] * alpha[w, s] * table[piece, 0] * beta[w, s + k + 1] / total[w], n_pieces)
        for word in long:
            cps = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            pieces = segmenter.pieces(cps)
            ahead = long_word(pieces, table)[:, 0]
            # backwards: the piece at (start, length) becomes the one that ends there
            n, longest = pieces.shape
            turned = np.full((n, longest), -1, np.int32)
            s, k = np.nonzero(pieces != -1)
            turned[n - s - k - 1, k] = pieces[s, k]
            behind = long_word(turned, table)[::-1, 0]
            good = pieces[s, k] >= 0
            s, k = s[good], k[good]
            piece = pieces[s, k]
            counts += np.bincount(piece, words[word] * table[piece, 0] * np.exp(ahead[s] + behind[s + k + 1] - ahead[-1]), n_pieces)
        prob = (counts + SMOOTH) / (counts.sum() + SMOOTH * n_pieces)
    return prob


def train(docs: DataFrame, path: str = VOCABULARY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and piece probabilities (pieces x languages) from labelled training documents."""
    pieces = vocabulary(path)
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    sizes = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("row").alias("different"))
    # about twice as many as wanted, without the others; then each row once, and the first of them in a random order
    bound = F.least(F.lit(1.0), 2 * TRAIN_DOCS / F.col("different")) * (1 << 30)
    drawn = seen.join(F.broadcast(sizes), "lang").where(F.pmod("row", F.lit(1 << 30)) <= bound)  # sizes: a row for each language
    order = F.row_number().over(Window.partitionBy("lang").orderBy("row"))
    picked = drawn.dropDuplicates(["lang", "row"]).withColumn("order", order).where(F.col("order") <= TRAIN_DOCS)

    def count(batches):
        found: dict[tuple[str, int], dict[str, int]] = {}
        for b in batches:
            for lang, n, text in zip(*(b.column(c).to_pylist() for c in ("lang", "n", "text")), strict=True):
                of = found.setdefault((lang, n), {})
                for w in words_of(text):
                    of[w] = of.get(w, 0) + 1
        for (lang, n), of in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(of) + 1), "n": pa.array([n] * (len(of) + 1), pa.int64()), "word": pa.array([*of, None], pa.string()), "times": pa.array([*of.values(), 0], pa.int64())})

    counted = picked.select("lang", "n", "text").mapInArrow(count, "lang string, n long, word string, times long").groupBy("lang", "n", "word").agg(F.sum("times").alias("times"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def fit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p = shared.value
        words = {w: n for w, n in zip(t.column("word").to_pylist(), t.column("times").to_pylist(), strict=True) if w is not None}
        prob = learn_words(words, Segmenter(p), len(p))
        return pa.table({"lang": [key[0].as_py()], "n": pa.array([t.column("n")[0].as_py()], pa.int64()), "prob": [prob.tobytes()]})

    rows = sorted(counted.groupBy("lang").applyInArrow(fit, "lang string, n long, prob binary").collect(), key=lambda r: r["lang"])
    shared.destroy()
    n = np.array([r["n"] for r in rows], float)
    return [r["lang"] for r in rows], np.log(n / n.sum()) if len(n) else n, np.stack([np.frombuffer(r["prob"]) for r in rows], 1) if rows else np.zeros((len(pieces), 0))


class Scorer:
    """Log likelihoods of texts, remembering words it has seen (forgetting them only costs time)."""

    def __init__(self, pieces: list[str], prob: np.ndarray) -> None:
        self.segmenter, self.prob, self.k = Segmenter(pieces), with_specials(prob), prob.shape[1]
        self.forget()

    def forget(self) -> None:
        self.known, self.logs = np.zeros(0, np.uint64), np.zeros((0, self.k))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts x languages) and numbers of words."""
        out, n_words = np.zeros((len(texts), self.k)), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") < CHUNK_CHARS):
                size += len(texts[to] or "") + 1
                to += 1
            lowered = [(t or "").lower() for t in texts[at:to]]
            sizes = np.array([len(t) + 1 for t in lowered])
            cps = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts, length = word_spans(cps)
            doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
            short = length <= SHORT_WORD
            s, n, d = starts[short], length[short], doc[short]
            for a in range(0, len(s), PART_WORDS):  # a long text in parts
                logs = self._words(cps, s[a : a + PART_WORDS], n[a : a + PART_WORDS])
                for k in range(self.k):
                    out[at:to, k] += np.bincount(d[a : a + PART_WORDS], logs[:, k], to - at)
            long: dict[bytes, np.ndarray] = {}
            for i in np.flatnonzero(~short):
                word = cps[starts[i] : starts[i] + length[i]]
                name = word.tobytes()
                if name not in long:
                    long[name] = self._long(word)
                out[at + doc[i]] += long[name]
            n_words[at:to] = np.bincount(doc, minlength=to - at)
            at = to
        return out, n_words

    def _long(self, word: np.ndarray) -> np.ndarray:
        return long_word(self.segmenter.pieces(word), self.prob)[-1]

    def _words(self, cps: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log likelihoods of at most ``PART_WORDS`` words of up to ``SHORT_WORD`` letters."""
        # their letters only, in a row
        cps = cps[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        starts = np.cumsum(length) - length
        h, first, inverse = np.unique(_hash(_sums(cps), starts, starts + length), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, h)
        have = np.zeros(len(h), bool)
        if len(self.known):
            have = self.known[np.minimum(place, len(self.known) - 1)] == h
        logs = np.zeros((len(h), self.k))
        logs[have] = self.logs[place[have]]
        new = np.flatnonzero(~have)
        if len(new):
            size = length[first[new]]
            for a, b in zip((0, *WIDTHS), (*WIDTHS, SHORT_WORD), strict=True):  # words of about one length
                some = new[(size > a) & (size <= b)]
                if len(some):
                    lat = self.segmenter.lattice(cps, starts[first[some]], length[first[some]])
                    last = forward(lat, self.prob)[np.arange(len(some)), lat.length]
                    logs[some] = np.log(np.maximum(last, LEAST))
                    for i in some[(last < LEAST).any(1)]:  # too small for a number that is no logarithm
                        logs[i] = self._long(cps[starts[first[i]] :][: length[first[i]]])
            if len(self.known) + len(new) > CACHE:
                self.forget()
                place = np.zeros(len(h), np.int64)
            self.known = np.insert(self.known, place[new], h[new])
            self.logs = np.insert(self.logs, place[new], logs[new], axis=0)
        return logs[inverse]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text)`` with ``held_out`` given."""
    languages, prior, prob = model
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(path), languages, prior, prob))

    def run(batches):
        pieces, languages, prior, prob = shared.value
        scorer = Scorer(pieces, prob) if languages else None
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                names, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if scorer:
                    logs, n = scorer.scores(b.column("text").to_pylist())
                    z = logs + prior
                    best = z.argmax(1)
                    p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                    names = [languages[best[i]] if n[i] else "und" for i in range(b.num_rows)]
                    score = np.where(n > 0, p, 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
