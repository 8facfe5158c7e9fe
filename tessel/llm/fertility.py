"""Quality rules on words, symbols and repeats, and on tokeniser fertility: how public vocabularies split a text.

Distinct words are tokenised once and remembered; per document the measures are characters per token (of a piece and of a
byte vocabulary), the share of byte-fallback tokens and the entropy of tokens. Bands for each script reject what lies
outside: text that vocabularies of natural language fall apart on, or that says the same few tokens over and over. The bands
come from the corpus: quartiles over all documents of a script that pass the base rules, and fences well outside of them.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, shared_dir, small_batches

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS, WINDOW = 50, 50, "#*$%&|<>", 3
#: Distinct words that a worker remembers; beyond that it starts anew.
MEMO = 300_000
#: Scripts that have bands of their own; a text is of the script that most of its letters are of.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai"]
OTHER = "other"
#: What is measured for the bands, which side rejects (below, above or both), and how far a fence is from the median at least
#: (as a factor; for the share of fallback tokens: how high it is at least).
BANDED = {"chars_per_piece": ("both", 2.0), "chars_per_byte_token": ("both", 2.0), "fallback_share": ("above", 0.3), "token_entropy": ("below", 2.0)}
#: A fence is so many times the distance of the quartiles beyond them. Wide bands, set by hand, weigh as much as PRIOR documents
#: of the script do, whatever the number of its documents: a script without any has these bands alone.
FENCE, PRIOR = 3.0, 100
WIDE = {
    "Latin": {"chars_per_piece": (1.4, 10.0), "chars_per_byte_token": (1.4, 10.0), "fallback_share": (-np.inf, 0.3), "token_entropy": (4.5, np.inf)},
    "any": {"chars_per_piece": (0.3, 10.0), "chars_per_byte_token": (0.2, 10.0), "fallback_share": (-np.inf, 0.9), "token_entropy": (4.0, np.inf)},
}
#: Measures are counted in so many steps for each doubling of 1 + the measure: the quartiles are right to 0.14 percent.
STEPS = 512
_LETTER = regex.compile(r"\p{L}")
_OF_SCRIPT = {k: regex.compile(rf"[\p{{L}}&&\p{{{k}}}]", regex.V1) for k in SCRIPTS}
_ASCII, _ASCII_LETTERS = bytes(range(128)), bytes(b for b in range(128) if chr(b).isalpha())


class Vocabularies:
    """A piece vocabulary with byte fallback and a byte-level one."""

    def __init__(self, pieces: str, ranks: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        size = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(k) for k in range(size)])


class Words:
    """Facts of distinct words: place in a table of tokens, counts of both vocabularies; bounded."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        self.v = vocabularies
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.tokens, self.starts, self.byte_tokens, self.chars = Growing(), Growing(), Growing(), Growing()
        self.starts.add([0])

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self.v.pieces.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts.add(self.tokens.n + np.cumsum(sizes))
        self.tokens.add(np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())))
        encode = self.v.bytes.encode_ordinary
        self.byte_tokens.add([len(encode(" " + t)) for t in texts])
        self.chars.add([len(t) for t in texts])
        for w in words:
            self.memo[w] = len(self.memo)


class Growing:
    """An array of longs that is appended to."""

    def __init__(self) -> None:
        self.n, self.room = 0, np.zeros(1024, np.int64)

    def add(self, values) -> None:
        while self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room, np.zeros_like(self.room)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


def repeated_words(ids: np.ndarray) -> int:
    """Places of words that lie in a window of WINDOW words which occurs at least twice; ids stand for words."""
    n = ids.size - WINDOW + 1
    if n < 2:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    key, base = ids[:n].astype(np.int64), int(ids.max()) + 1
    for k in range(1, WINDOW):  # numbers of the longer and longer windows: no overflow, no collision
        _, key = np.unique(key * base + ids[k : k + n], return_inverse=True)
    often = np.bincount(key)[key] > 1
    marks = np.zeros(ids.size + 1, np.int64)
    for k in range(WINDOW):
        marks[k : k + n] += often
    return int((marks[:-1] > 0).sum())


def script_of(text: bytes) -> str:
    """The script that most letters are of (the first of SCRIPTS among equals; Latin if there is no letter); other if most
    are of none of them."""
    ascii_letters = len(text) - len(text.translate(None, _ASCII_LETTERS))
    letters = _LETTER.findall(text.translate(None, _ASCII).decode("utf-8", "replace"))
    if ascii_letters >= len(letters):
        return SCRIPTS[0]
    rest = "".join(letters)
    counts = {k: len(p.findall(rest)) for k, p in _OF_SCRIPT.items()}
    counts[SCRIPTS[0]] += ascii_letters
    best = max(counts, key=counts.get)
    return best if counts[best] > ascii_letters + len(letters) - sum(counts.values()) else OTHER


MEASURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(),
    "script": pa.string(), "chars_per_piece": pa.float64(), "chars_per_byte_token": pa.float64(), "fallback_share": pa.float64(), "token_entropy": pa.float64(),
}


def measure(text: bytes, words: Words) -> tuple:
    """All measures of one text, in the order of MEASURES."""
    own = text.split()  # of bytes: exactly the ASCII white space
    n = len(own)
    if len(words.memo) > MEMO:
        words.clear()
    if new := {w for w in own if w not in words.memo}:
        words.learn(list(new))
    ids = np.fromiter(map(words.memo.__getitem__, own), np.int64, n)
    flat, starts, byte_tokens, chars = words.tokens.room, words.starts.room, words.byte_tokens.room, words.chars.room
    word_chars = int(chars[ids].sum())
    sizes = starts[ids + 1] - starts[ids]
    total, others = int(sizes.sum()), int(byte_tokens[ids].sum())
    each, times = np.unique(ids, return_counts=True)
    spans = starts[each + 1] - starts[each]
    at = np.repeat(starts[each] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
    tokens, weight = flat[at], np.repeat(times, spans)
    per_token = np.bincount(tokens, weights=weight) if tokens.size else np.zeros(1)
    share = per_token[per_token > 0] / max(total, 1)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0 if total else 0.0
    fallback = float(weight[words.v.fallback[tokens]].sum() / total) if total else 0.0
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeated_words(ids)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    per_piece, per_byte = word_chars / max(total, 1), (word_chars + n) / max(others, 1)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, script_of(text), per_piece, per_byte, fallback, entropy


def measured(docs: DataFrame, text_col: str = "text", pieces: str | None = None, ranks: str | None = None) -> DataFrame:
    """Adds MEASURES to every row of docs, in place of columns of these names.

    A null or empty text has no words: it fails the base rules. Whole texts are measured, whatever their length; repeated
    rows each; an empty table gives an empty one. The vocabulary files must be on every executor.
    """
    import public_tokenizers as P

    small_batches(docs.sparkSession)
    pieces, ranks, pattern = pieces or P.path("piece_bpe_32k.model"), ranks or P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    docs = docs.drop(*MEASURES)
    at = docs.columns.index(text_col)

    def run(batches):
        words = Words(Vocabularies(pieces, ranks, pattern))
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            rows = [measure(t, words) for t in texts]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(MEASURES.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *MEASURES])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {kinds[v]}" for k, v in MEASURES.items())])
    return docs.mapInArrow(run, schema)


def quartiles(steps: np.ndarray, counts: np.ndarray) -> tuple[float, float, float]:
    """Lower quartile, median and upper quartile of values counted in steps."""
    order = np.argsort(steps)
    places = np.searchsorted(np.cumsum(counts[order]), np.array([0.25, 0.5, 0.75]) * counts.sum())
    return tuple((np.exp2(steps[order][places] / STEPS) - 1).tolist())


def fit_bands(found: DataFrame) -> dict[str, dict[str, tuple[float, float]]]:
    """script -> measure -> (least, most), from all rows of measured() that pass the base rules.

    Values are counted in steps of their logarithm, so what reaches the driver is bounded by the steps, the same on every run.
    The fences lie FENCE quartile distances beyond the quartiles, and where the values hardly differ as far from the median
    as BANDED says. Each is then drawn toward that of WIDE: the mean of both, weighted by the script's rows and PRIOR.
    """
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in BANDED])).alias("v")
    step = F.floor(F.log2(F.col("v.x") + 1) * STEPS).cast("int").alias("step")
    rows = found.where(~F.col("base_failed")).select("script", value).groupBy("script", F.col("v.measure").alias("measure"), step).count().collect()
    out = {script: dict(WIDE.get(script, WIDE["any"])) for script in [*SCRIPTS, OTHER]}
    for script, measure in sorted({(r.script, r.measure) for r in rows}):
        own = [(r["step"], r["count"]) for r in rows if (r.script, r.measure) == (script, measure)]
        steps, counts = np.array(own, dtype=np.int64).T
        low, middle, high = quartiles(steps, counts)
        side, far = BANDED[measure]
        least, most = low - FENCE * (high - low), high + FENCE * (high - low)
        least, most = (least, max(most, far)) if measure == "fallback_share" else (min(least, middle / far), max(most, middle * far))
        n, (wide_least, wide_most) = counts.sum(), out[script][measure]
        drawn = lambda fitted, wide, n=n: (n * fitted + PRIOR * wide) / (n + PRIOR)
        out[script][measure] = (drawn(least, wide_least) if side != "above" else -np.inf, drawn(most, wide_most) if side != "below" else np.inf)
    return out


def judged(found: DataFrame, bands: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """Adds kept to rows of measured(): false if the base rules fail or a measure lies outside the band of the script."""
    outside = F.lit(False)
    for script, own in bands.items():
        for measure, (least, most) in own.items():
            outside |= (F.col("script") == script) & ~F.col(measure).between(float(least), float(most))
    return found.withColumn("kept", ~(F.col("base_failed") | outside))


def quality(docs: DataFrame, text_col: str = "text", pieces: str | None = None, ranks: str | None = None) -> DataFrame:
    """Adds MEASURES and kept to every row of docs, in place of columns of these names: measured(), then judged() by the
    bands of the corpus itself. What is measured is written to the shared folder, so it is measured once."""
    found = saved(measured(docs.drop("kept"), text_col, pieces, ranks), shared_dir(docs.sparkSession), "measured")
    return judged(found, fit_bands(found))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    found = measured(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    found = saved(found, shared_dir(spark), "measured")
    return judged(found, fit_bands(found))
