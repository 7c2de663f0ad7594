"""Quality rules: base measures and n-gram perplexity bands for each language.

The language model is an interpolated modified Kneser-Ney model of bytes:
Spark counts all 4-grams of all texts, and counts of counts, continuation
counts, discounts and probabilities are joins and windows over the counts.
Each of the 256 bytes is a symbol of its own, so a 4-gram is a 32-bit number, its
context the upper and its shorter form the lower 24 bits.  The model has the
4-grams that occur, which go to the tasks as sorted arrays and are searched there.
A second, coarser model of 64 classes of bytes is made of the same counts: it sees
patterns whose bytes vary, such as runs of marks.  Documents outside their
language's band in either model are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.textbytes import Hashes, mixed, per_text, slices
from pageflow.sources.shared import staged

ORDER = 4
#: Distinct grams a task counts before it hands on what it has.
HELD_GRAMS = 1_000_000
#: Bytes of text scored at once; each takes some 100 bytes of arrays meanwhile.
SCORED_BYTES = 256 << 10


@dataclass(frozen=True)
class QualitySettings:
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_words: int = 8
    symbols: str = "#*$%&|<>"
    #: On each side of its median a band reaches so many times the distance of that side's quartile.
    reach: float = 4.0
    #: The same for the model of bytes, whose scores scatter more: few rare bytes weigh much.
    byte_reach: float = 5.0
    #: Neither side's distance is below this share of the other's, nor below this log perplexity.
    least_side: float = 0.5
    least_spread: float = 0.005
    #: A text of so many bytes counts half by its own log perplexity, half by its language's median.
    steady_bytes: int = 400


def byte_classes() -> np.ndarray:
    """Class of each byte: blank, line feed, a-z, capitals, digits, marks, and 24 of other bytes."""
    out = np.empty(256, np.uint8)
    out[:128] = 37
    out[[32, 9, 11, 12, 13]] = 0
    out[10] = 1
    out[97:123] = np.arange(2, 28)
    out[65:91] = 28
    out[48:58] = 29
    for i, marks in enumerate((".", ",", "!?", ":;", "'\"", "()[]{}", "-_/")):
        out[[ord(c) for c in marks]] = 30 + i
    out[128:] = 40 + np.arange(128, 256) % 24
    return out


@dataclass(frozen=True, eq=False)
class Alphabet:
    """Symbol of each byte, and the bits of a symbol."""

    bits: int
    symbols: np.ndarray


#: Every byte is a symbol: the model's alphabet.
BYTES = Alphabet(8, np.arange(256, dtype=np.uint8))
#: Bytes by their class, for the second model.
CLASSES = Alphabet(6, byte_classes())


def _grams(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """The 4-gram that ends at each byte; blanks stand before a text."""
    symbols = alphabet.symbols[data].astype(np.uint32)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    grams = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.empty_like(symbols)
        earlier[back:] = symbols[:-back]
        earlier[at < back] = alphabet.symbols[32]
        grams |= earlier << np.uint32(alphabet.bits * back)
    return grams


def _tally(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and how often each occurs, or the sum of its counts."""
    if counts is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.diff(np.append(starts, len(grams))) if counts is None else np.add.reduceat(counts, starts)


class _Counter:
    """Counts of 4-grams, as sorted parts that are merged when they have doubled."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def add(self, grams: np.ndarray) -> None:
        if len(grams):
            self.parts.append(_tally(grams))
            self.size += len(self.parts[-1][0])
            if self.size > 2 * self.merged + HELD_GRAMS // 8:
                self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_tally(*(np.concatenate(x) for x in zip(*self.parts)))]
        self.size = self.merged = sum(len(g) for g, _ in self.parts)

    def batches(self, language: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        for grams, counts in self.parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))],
                names=["lang", "gram", "n"],
            )


def _languages(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()], object)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", alphabet: Alphabet = CLASSES) -> DataFrame:
    """Rows (lang, gram, n) over all texts; each task adds up its own part first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counter] = {}
        for batch in batches:
            languages = _languages(batch, "lang")
            for first, last, data, offsets in slices(batch, "text", SCORED_BYTES):
                grams, sizes = _grams(data, offsets, alphabet), np.diff(offsets)
                for language in sorted(set(languages[first:last])):
                    mine = np.repeat(languages[first:last] == language, sizes)
                    held.setdefault(language, _Counter()).add(grams[mine])
                if sum(c.size for c in held.values()) > HELD_GRAMS:
                    for c in held.values():
                        c.merge()
                    if sum(c.size for c in held.values()) > HELD_GRAMS // 2:
                        yield from (b for k, c in held.items() for b in c.batches(k))
                        held = {}
        yield from (b for k, c in held.items() for b in c.batches(k))

    narrow = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = narrow.mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def coarser(counts: DataFrame, alphabet: Alphabet = CLASSES) -> DataFrame:
    """Counts (lang, gram, n) of bytes as counts of the symbols of another alphabet."""

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("gram").to_numpy()
            grams = np.zeros(len(found), np.int64)
            for back in reversed(range(ORDER)):
                grams = grams << alphabet.bits | alphabet.symbols[found >> 8 * back & 255]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(grams), batch.column("n")], names=["lang", "gram", "n"])

    named = counts.mapInArrow(renamed, "lang string, gram long, n long")
    return named.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 of each language, from counts of counts."""
    ones, twos, threes, fours = (F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4))
    counted = grams.groupBy("lang").agg(ones.alias("n1"), twos.alias("n2"), threes.alias("n3"), fours.alias("n4"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        """Within [0, k]; where a count of counts is 0, half of k."""
        usual = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(k)), F.coalesce(usual, F.lit(k / 2))))

    guarded = counted.withColumn("n1", F.greatest("n1", F.lit(1e-9)))
    return guarded.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])


def kneser_ney(counts: DataFrame, alphabet: Alphabet = CLASSES) -> DataFrame:
    """Rows (lang, gram, logp): natural log probability of a gram's last symbol after the others."""
    levels = [staged(counts, "grams")]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (alphabet.bits * order)) - 1)
        levels.append(staged(levels[-1].groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    lower = None
    for order, grams in enumerate(reversed(levels), 1):
        n = F.col("n")
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", F.shiftright("gram", alphabet.bits))
        shared = grams.join(F.broadcast(_discounts(grams)), "lang").withColumn("cut", cut)
        shared = shared.select(
            "lang",
            "gram",
            ((n - F.col("cut")) / F.sum("n").over(context)).alias("own"),
            (F.sum("cut").over(context) / F.sum("n").over(context)).alias("left"),
        )
        if lower is None:
            p = shared.withColumn("p", F.col("own") + F.col("left") / (1 << alphabet.bits))
        else:
            shorter = F.col("gram").bitwiseAND((1 << (alphabet.bits * (order - 1))) - 1)
            p = shared.withColumn("short", shorter).join(
                lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q")), ["lang", "short"]
            )
            p = p.withColumn("p", F.col("own") + F.col("left") * F.col("q"))
        lower = p.select("lang", "gram", "p")
    return lower.select("lang", "gram", F.log("p").alias("logp"))


class PerplexityModel:
    """Sorted grams and their log probabilities for each language; ``coarse`` is the model of classes."""

    def __init__(
        self, arrays: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: Alphabet = BYTES, coarse: PerplexityModel | None = None
    ) -> None:
        self.arrays = arrays
        self.alphabet = alphabet
        self.coarse = coarse
        self.lowest = {k: logp.min(initial=0) for k, (_, logp) in arrays.items()}

    def scores(self, language: str, grams: np.ndarray) -> np.ndarray:
        """Log probabilities; a gram the model lacks gets its lowest one."""
        ids, logp = self.arrays[language]
        if not len(ids):
            return np.zeros(len(grams), logp.dtype)
        at = np.minimum(np.searchsorted(ids, grams), len(ids) - 1)
        return np.where(ids[at] == grams, logp[at], self.lowest[language])

    def log_perplexity(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> pa.Array:
        """Of each text of a slice; null without text."""
        sizes = np.diff(offsets)
        # the grams of a text in their order, which are found faster; a sum is the same wherever its text lies
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes)
        grams = np.sort(owner | _grams(data, offsets, self.alphabet)).astype(np.uint32)
        logp = np.zeros(len(data))
        for language in sorted(set(languages)):
            mine = np.repeat(languages == language, sizes)
            if mine.any():
                logp[mine] = self.scores(language, grams[mine])
        total, filled = np.zeros(len(sizes)), np.flatnonzero(sizes)
        if len(filled):
            total[filled] = np.add.reduceat(logp, offsets[:-1][filled])
        return pa.array(-total / np.maximum(sizes, 1), mask=sizes == 0)


def _fitted(counts: DataFrame, alphabet: Alphabet, coarse: PerplexityModel | None = None) -> PerplexityModel:
    """The model of staged counts, brought to the driver: the grams that occur in each language."""
    logp = kneser_ney(counts, alphabet).select("lang", "gram", F.col("logp").cast("float").alias("logp"))
    table = logp.toArrow()
    named = table.column("lang").combine_chunks().dictionary_encode()
    codes = named.indices.to_numpy()
    grams, values = (table.column(c).to_numpy() for c in ("gram", "logp"))
    arrays = {}
    for code, language in enumerate(named.dictionary.to_pylist()):
        mine = codes == code
        order = np.argsort(grams[mine])
        arrays[language] = grams[mine][order].astype(np.uint32), values[mine][order]
    return PerplexityModel(arrays, alphabet, coarse)


def trained_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> PerplexityModel:
    """Count all bytes of all texts; the models of bytes and of classes of these counts."""
    counts = staged(gram_counts(docs, text, lang, BYTES), "byte-grams")
    return _fitted(counts, BYTES, _fitted(coarser(counts), CLASSES))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _measures(data: np.ndarray, offsets: np.ndarray, settings: QualitySettings) -> list[np.ndarray]:
    """The five measures of each text of a slice, in the order of MEASURES."""
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    in_word = ~blank
    before = np.concatenate([[True], blank[:-1]]) | first[:-1]
    starts = np.flatnonzero(in_word & before)
    after = np.concatenate([blank[1:], [True]]) | first[1:]
    ends = np.flatnonzero(in_word & after) + 1
    hashes = Hashes(data)
    words = hashes.of(starts, ends)
    owner = text_of[starts]

    size = settings.repeat_words
    repeated = np.zeros(len(words), bool)
    if len(words) >= size:
        windows = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
        whole = np.flatnonzero(owner[: len(windows)] == owner[size - 1 :])
        again = whole[_duplicates(mixed(windows[whole]), owner[whole])]
        cover = np.zeros(len(words) + 1, np.int32)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + size, -1)
        repeated = np.cumsum(cover[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[~first[breaks + 1]] + 1]))
    line_ends = np.minimum(
        np.concatenate([line_starts[1:], [len(data)]]), np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, line_starts)]
    ) if len(line_starts) else line_starts
    word_sums = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    holds = word_sums[line_ends] > word_sums[line_starts]
    line_starts, line_ends = line_starts[holds], line_ends[holds]
    line_owner = text_of[line_starts]
    _, kinds = np.unique(_in_text(hashes.of(line_starts, line_ends), line_owner), return_index=True)
    lines = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[kinds], minlength=n)

    symbols = np.isin(np.arange(256), list(settings.symbols.encode()))[data]
    return [
        np.bincount(owner, minlength=n),
        per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        per_text(symbols, offsets),
        lines,
        np.bincount(owner[repeated], minlength=n),
    ]


def _in_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1)))


def _duplicates(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more within their text."""
    _, kind, count = np.unique(_in_text(hashes, owner), return_inverse=True, return_counts=True)
    return count[kind] > 1


def measured(
    docs: DataFrame,
    model: Broadcast,
    settings: QualitySettings = QualitySettings(),
    text: str = "text",
    lang: str = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) of the documents, the MEASURES, ``text_bytes``, ``log_perplexity`` and, of classes, ``class_perplexity``.

    A row's new columns replace columns of the same names.  A null text is
    empty; a null language is the language ''; without text the log perplexity
    is null.  Nothing moves between tasks.
    """
    added = [f.split()[0] for f in MEASURES.split(", ")] + ["text_bytes", "log_perplexity", "class_perplexity"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # a text that is kept goes to Python once
    text_name, lang_name = (
        c if c in kept and kinds[c] == "string" else name for c, name in ((text, "__text"), (lang, "__lang"))
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = _languages(batch, lang_name)
            for first, last, data, offsets in slices(batch, text_name, SCORED_BYTES):
                own, sizes = languages[first:last], np.diff(offsets)
                scores = [
                    pa.nulls(len(sizes), pa.float64()) if of is None else of.log_perplexity(data, offsets, own)
                    for of in (model.value, model.value.coarse)
                ]
                part = batch.slice(first, last - first)
                columns = [part.column(i) for i in range(len(kept))]
                columns += [pa.array(x.astype(np.int64)) for x in _measures(data, offsets, settings)]
                columns.append(pa.array(sizes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*columns, *scores], names=[*kept, *added])

    own = [F.col(c).cast("string").alias(name) for c, name in ((text, text_name), (lang, lang_name)) if name not in kept]
    read = docs.select(*[F.col(c) for c in kept], *own)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return read.mapInArrow(measure, f"{fields}, {MEASURES}, text_bytes long, log_perplexity double, class_perplexity double")


#: Column that tells texts apart where scores are gathered.
TEXT_DIGEST = "__text_digest"


def _scored(docs: DataFrame, model: Broadcast, settings: QualitySettings, key: str, text: str, lang: str) -> DataFrame:
    named = docs.withColumn(TEXT_DIGEST, F.xxhash64(F.col(text).cast("string")))
    return staged(measured(named, model, settings, text, lang, [key, lang, TEXT_DIGEST]), "scores")


def base_failed(settings: QualitySettings = QualitySettings()) -> Column:
    repeats = 100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words")
    return (F.col("n_words") < settings.min_words) | repeats


#: Scores with a band, and what the names of the band's columns begin with.
_BANDED = {"log_perplexity": "", "class_perplexity": "class_"}


def _score(value: str, settings: QualitySettings) -> Column:
    """Log perplexity drawn towards the language's median, the more the shorter the text."""
    middle = F.col(f"{_BANDED[value]}middle")
    weight = F.col("text_bytes") / (F.col("text_bytes") + settings.steady_bytes)
    return middle + (F.col(value) - middle) * weight


def perplexity_bands(scored: DataFrame, settings: QualitySettings = QualitySettings(), lang: str = "lang") -> DataFrame:
    """Rows (band_lang, middle, low, high, and the same of classes) from all texts that the base rules let pass.

    A text counts once, however many copies it has: rows of one language with the
    same TEXT_DIGEST are one.  So a group of copies moves a band as little as any other text.
    """

    def quantiles(value: Column, *at: float) -> Column:
        return F.percentile_approx(value, F.array(*map(F.lit, at)), F.lit(10_000))

    values = [v for v in _BANDED if v in scored.columns]
    sound = scored.where(~base_failed(settings)).withColumn("band_lang", F.coalesce(F.col(lang), F.lit("")))
    sound = sound.dropDuplicates(["band_lang", TEXT_DIGEST]).select("band_lang", "text_bytes", *values)
    sound = staged(sound, "distinct-scores")
    middles = [quantiles(F.col(v), 0.5)[0].alias(f"{_BANDED[v]}middle") for v in values]
    middles = staged(sound.groupBy("band_lang").agg(*middles), "middles")
    found = sound.join(middles, "band_lang").groupBy(*middles.columns).agg(
        *[quantiles(_score(v, settings), 0.25, 0.75).alias(f"{_BANDED[v]}q") for v in values]
    )
    bands = []
    for value in values:
        name = _BANDED[value]
        reach = settings.reach if name else settings.byte_reach
        middle, q = F.col(f"{name}middle"), F.col(f"{name}q")
        below, above = middle - q[0], q[1] - middle
        side = lambda own, other: F.greatest(own, other * settings.least_side, F.lit(settings.least_spread))
        low, high = middle - side(below, above) * reach, middle + side(above, below) * reach
        bands += [middle, low.alias(f"{name}low"), high.alias(f"{name}high")]
    return found.select("band_lang", *bands)


def judged(scored: DataFrame, bands: DataFrame, settings: QualitySettings = QualitySettings(), lang: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``; a language without a band keeps nothing."""
    inside = F.lit(True)
    for value, name in _BANDED.items():
        if f"{name}low" in bands.columns:
            inside = inside & _score(value, settings).between(F.col(f"{name}low"), F.col(f"{name}high"))
    joined = scored.join(bands, F.coalesce(F.col(lang), F.lit("")) == F.col("band_lang"), "left")
    failed = base_failed(settings)
    return joined.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.coalesce(inside, F.lit(False))
    ).drop("band_lang")


def quality(
    docs: DataFrame, settings: QualitySettings = QualitySettings(), key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Rows (key, lang, measures, log_perplexity, band, base_failed, kept) of all documents.

    Repeated rows are judged each; an empty table gives no row.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained_model(docs, text, lang))
    scored = _scored(docs, model, settings, key, text, lang)
    return judged(scored, staged(perplexity_bands(scored, settings, lang), "bands"), settings, lang).drop(TEXT_DIGEST)


def passed(
    docs: DataFrame, settings: QualitySettings = QualitySettings(), key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The documents that pass, all their columns; texts are scored in place and never move."""
    model = docs.sparkSession.sparkContext.broadcast(trained_model(docs, text, lang))
    scored = _scored(docs, model, settings, key, text, lang)
    bands = staged(perplexity_bands(scored, settings, lang), "bands")
    renamed = docs.select(*[F.col(c).alias(f"__doc_{c}") for c in docs.columns])
    judged_rows = judged(measured(renamed, model, settings, f"__doc_{text}", f"__doc_{lang}"), bands, settings, f"__doc_{lang}")
    return judged_rows.where("kept").select(*[F.col(f"__doc_{c}").alias(c) for c in docs.columns])
