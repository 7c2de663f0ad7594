"""Collocations: word phrases that occur far more often than their parts suggest.

Counting.  Texts become blocks of local word numbers.  A phrase that is frequent
has frequent parts, so blocks first ask which of their words and word pairs are
frequent in their language over the whole corpus, then the same of the phrases
of three and four words all of whose pairs are.  A block sends each different
phrase once, as 32 bits and a count within a range of hashes, to the task that
owns the range, and gets one bit back.  Phrases behind the set bits are written
out as text and counted by their text, so hashes choose what is counted and
never what a count is.

Scoring.  The count stream is kept in suffix order and then in prefix order, by
sorted ranges.  In either order a phrase comes right before its extensions, so
one pass that steps through phrases of all lengths together reads off, for each
phrase, the counts of all its first (or last) words and the highest count of a
phrase that extends it on that side; nothing is looked up in a hash table.
Phrases that go on over a border between ranges leave at most three rows a range,
which are settled afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.blocks import mask_of, pack, unpack
from pageflow.llm.textbytes import Hashes, mixed, slices
from pageflow.sources.shared import fresh_path, staged


@dataclass(frozen=True)
class CollocationSettings:
    least: int = 30
    #: A phrase goes if one that holds it has at least this share of its occurrences, in percent.
    held_percent: int = 80
    scale: int = 2_000_000
    top: int = 2_000
    no_language: str = "und"
    #: Phrases of one range of hashes, about, and the least that a block sends to a range.
    range_keys: int = 1 << 18
    row_keys: int = 64


#: Fixed by the grammar of texts: words end at blanks, pieces at marks and line ends.
BLANKS = b" \t"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 4

_STEP = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BLOCK = (
    "block long, n_words long, langs array<string>, lang_words array<long>, vocabulary binary, vocabulary_bytes long,"
    " vocabulary_lang binary, tokens binary"
)


def _language_hash(languages: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in languages], np.uint64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text, joined) of the words; joined: the next word is in the same piece."""
    n = len(offsets) - 1
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    in_word = kind == 0
    starts = np.flatnonzero(in_word & (np.concatenate([[True], ~in_word[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(in_word & (np.concatenate([~in_word[1:], [True]]) | edge[1:])) + 1
    text = np.repeat(np.arange(n), np.diff(offsets))[starts]
    cuts = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int64)])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (cuts[starts[1:]] == cuts[ends[:-1]]) & (text[1:] == text[:-1])
    return starts, ends, text, joined


def word_blocks(docs: DataFrame, text: str = "text", lang: str = "lang", no_language: str = "und") -> DataFrame:
    """Store the texts as blocks of word numbers, each with its own vocabulary."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for first, last, raw, offsets in slices(batch, "text"):
                data = _LOWER[raw]
                starts, ends, owner, joined = _tokens(data, offsets)
                if not len(starts):
                    continue
                langs, of_text = np.unique(np.array(languages[first:last], object), return_inverse=True)
                of_word = of_text[owner]
                hashes = mixed(Hashes(data).of(starts, ends) ^ _language_hash(list(langs))[of_word])
                _, sample, ids = np.unique(hashes, return_index=True, return_inverse=True)
                spelled = data.tobytes()
                words = b" ".join([spelled[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)])
                tokens = (ids.astype(np.int32) << 1) | joined
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.array([len(starts)]),
                        pa.array([list(langs)], pa.list_(pa.string())),
                        pa.array([np.bincount(of_word, minlength=len(langs)).tolist()], pa.list_(pa.int64())),
                        pa.array([pack(np.frombuffer(words, np.uint8))], pa.binary()),
                        pa.array([len(words)]),
                        pa.array([pack(of_word[sample].astype(np.int32).view(np.uint8))], pa.binary()),
                        pa.array([pack(tokens.astype(np.int32).view(np.uint8))], pa.binary()),
                    ],
                    names=[f.strip().split()[0] for f in _BLOCK.split(",")],
                )
                number += 1

    spark = docs.sparkSession
    path = fresh_path(spark, "word-blocks")
    language = F.coalesce(F.col(lang).cast("string"), F.lit(no_language))
    narrow = docs.select(F.col(text).cast("string").alias("text"), language.alias("lang"))
    narrow.mapInArrow(blocks, _BLOCK).write.parquet(path)
    return spark.read.schema(_BLOCK).parquet(path)


class _Words:
    """An opened block: its vocabulary in order of hashes, and its words."""

    def __init__(self, row: dict) -> None:
        self.langs = row["langs"]
        text = unpack(pa.py_buffer(row["vocabulary"]), row["vocabulary_bytes"])
        gaps = np.flatnonzero(text == 32)
        self.text = text.tobytes()
        self.starts, self.ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])
        self.lang = unpack(pa.py_buffer(row["vocabulary_lang"]), 4 * len(self.starts)).view(np.int32)
        tokens = unpack(pa.py_buffer(row["tokens"]), 4 * row["n_words"]).view(np.int32)
        self.ids, self.joined = tokens >> 1, (tokens & 1).astype(bool)
        self.hashes = mixed(Hashes(text).of(self.starts, self.ends) ^ _language_hash(self.langs)[self.lang])

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words of pairs, hashes of pairs, hashes of all words and pairs)."""
        at = np.flatnonzero(self.joined)
        words = self.hashes[self.ids]
        pairs = mixed(words[at] * _STEP + words[at + 1])
        return at, pairs, np.concatenate([self.hashes, pairs])

    def long(self, at: np.ndarray, pairs: np.ndarray, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(first words, hashes) of the phrases of three and of four words whose pairs are all frequent."""
        held = np.zeros(len(self.ids) + LONGEST, bool)
        held[at[frequent]] = True
        chained = np.zeros(len(self.ids) + LONGEST, np.uint64)
        chained[at] = pairs
        out = []
        words = np.concatenate([self.hashes[self.ids], np.zeros(LONGEST, np.uint64)])
        reach = held
        for n in range(3, LONGEST + 1):
            reach = reach[: len(self.ids)] & held[n - 2 : n - 2 + len(self.ids)]
            first = np.flatnonzero(reach)
            chained = mixed(chained[: len(self.ids)] * _STEP + words[n - 1 : n - 1 + len(self.ids)])
            out.append((first, chained[first]))
        return out

    def phrases(self, first: np.ndarray, kind: np.ndarray, n_words: int) -> Iterator[tuple[str, str, int]]:
        """(language, text, count) of each kind of phrase, from where it begins."""
        _, sample, counts = np.unique(kind, return_index=True, return_counts=True)
        for at, n in zip(first[sample].tolist(), counts.tolist(), strict=True):
            ids = self.ids[at : at + n_words]
            spelled = b" ".join([self.text[self.starts[i] : self.ends[i]] for i in ids])
            yield self.langs[self.lang[ids[0]]], spelled.decode(errors="replace"), n


def _keys(block: _Words, short_mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of a step's phrases and how often the block has each."""
    at, pairs, every = block.short()
    if short_mask is None:
        weights = np.concatenate([np.bincount(block.ids, minlength=len(block.hashes)), np.ones(len(pairs), np.int64)])
        keys, kind = np.unique(every, return_inverse=True)
        return keys, np.bincount(kind, weights=weights, minlength=len(keys)).astype(np.int64)
    keys, kind = np.unique(every, return_inverse=True)
    frequent = short_mask[kind[len(block.hashes) :]]
    longer = block.long(at, pairs, frequent)
    return np.unique(np.concatenate([h for _, h in longer]), return_counts=True)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _mask(row: dict, column: str) -> np.ndarray:
    return mask_of(pa.scalar(row[column], pa.list_(pa.struct([("range", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())]))))


def frequent_masks(blocks: DataFrame, settings: CollocationSettings, name: str) -> DataFrame:
    """Rows (block, name): one bit for each hash of the block's phrases, in order, if it is frequent in the corpus.

    Blocks with a column ``short`` ask for longer phrases, others for words and
    pairs.  Counts stop at 255 on their way, which is above any bound asked for.
    """
    if settings.least > 255:
        raise ValueError("least is at most 255")
    words, n_blocks = blocks.agg(F.sum("n_words"), F.count(F.lit(1))).first()
    keys_each = 2 * (words or 0) // max(1, n_blocks)
    ranges = max(1, min(2 * (words or 0) // settings.range_keys, keys_each // settings.row_keys))
    least, longer = settings.least, "short" in blocks.columns

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, counts = _keys(_Words(row), _mask(row, "short") if longer else None)
                owner = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cuts))
                few = np.minimum(counts, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int64)),
                        pa.array(np.full(len(used), row["block"], np.int64)),
                        pa.array([keys[cuts[r] : cuts[r + 1]].astype(np.uint32).tobytes() for r in used], pa.binary()),
                        pa.array([few[cuts[r] : cuts[r + 1]].tobytes() for r in used], pa.binary()),
                    ],
                    names=["range", "block", "keys", "counts"],
                )

    def compare(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(b, np.uint8) for b in table.column("counts").to_pylist()]
        keys = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("keys").to_pylist()])
        order = np.argsort(keys, kind="stable")
        run = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
        total = np.bincount(run, weights=np.concatenate(counts)[order])
        often = np.empty(len(keys), bool)
        often[order] = (total >= least)[run]
        ends = np.cumsum([len(c) for c in counts])
        bits = [np.packbits(often[e - len(c) : e]).tobytes() for c, e in zip(counts, ends, strict=True)]
        return pa.table(
            {
                "block": table.column("block"), "range": table.column("range"), "bits": pa.array(bits, pa.binary()),
                "n": pa.array([len(c) for c in counts], pa.int64()),
            }
        )

    sent = blocks.mapInArrow(split, "range long, block long, keys binary, counts binary")
    answers = sent.groupBy("range").applyInArrow(compare, "block long, range long, bits binary, n long")
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "bits", "n"))).alias(name))


def _spelled(blocks: DataFrame) -> DataFrame:
    """Rows (lang, phrase, n) of what the masks leave, added up within blocks."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = _Words(row)
                at, pairs, every = block.short()
                _, kind = np.unique(every, return_inverse=True)
                frequent = _mask(row, "short")[kind]
                longer = block.long(at, pairs, frequent[len(block.hashes) :])
                hashes = np.concatenate([h for _, h in longer])
                _, kind = np.unique(hashes, return_inverse=True)
                often = _mask(row, "long")[kind] if len(hashes) else np.zeros(0, bool)
                out: list[tuple[str, str, int]] = []
                words = np.flatnonzero(frequent[block.ids])
                out += block.phrases(words, block.ids[words], 1)
                kept = frequent[len(block.hashes) :]
                out += block.phrases(at[kept], pairs[kept], 2)
                begin = 0
                for n, (first, h) in enumerate(longer, 3):
                    kept = often[begin : begin + len(h)]
                    out += block.phrases(first[kept], h[kept], n)
                    begin += len(h)
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                    names=["lang", "phrase", "n"],
                )

    return blocks.mapInArrow(spell, "lang string, phrase string, n long")


def frequent_phrases(blocks: DataFrame, settings: CollocationSettings = CollocationSettings()) -> DataFrame:
    """Stored rows (lang, words, f): all phrases of one to four words with at least ``least`` occurrences."""
    short = blocks.join(frequent_masks(blocks, settings, "short"), "block")
    short = staged(short, "short-masks")
    both = short.join(frequent_masks(short, settings, "long"), "block", "left")
    counted = _spelled(both).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= settings.least)
    return staged(counted.select("lang", F.split("phrase", " ").alias("words"), "f"), "phrases")


_LOCKSTEP = "part long, lang string, words array<string>, f long, heads array<long>, longer long"
_LOCKSTEP_SCHEMA = [
    ("part", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()),
    ("heads", pa.list_(pa.int64())), ("longer", pa.int64()),
]


def lockstep(phrases: DataFrame, carried: dict[str, str] | None = None) -> DataFrame:
    """Add to rows (lang, words, f) ``heads``, the counts of their first 1, 2, ... words, and ``longer``.

    ``longer`` is the highest count of a phrase with one word more that begins
    with them, or 0.  All of a phrase's first words must be rows, too.  The
    columns ``carried`` (name to type) stay.
    """
    kept = carried or {}
    schema = pa.schema(
        [*_LOCKSTEP_SCHEMA, *[(c, pa.list_(pa.int64()) if t.startswith("array") else pa.int64()) for c, t in kept.items()]]
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # the last phrase and all its first words, shortest first; without a count where an earlier range has the row
        held: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                words = row["words"]
                while held and (held[-1]["lang"] != row["lang"] or held[-1]["words"] != words[: len(held[-1]["words"])]):
                    done.append(held.pop())
                while len(held) < len(words) - 1:
                    held.append({"part": part, "lang": row["lang"], "words": words[: len(held) + 1], "f": None, "longer": 0})
                if held:
                    held[-1]["longer"] = max(held[-1]["longer"], row["f"])
                held.append(row | {"part": part, "heads": [h["f"] for h in held], "longer": 0})
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    ordered = phrases.select("lang", "words", "f", *kept).repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    stepped = staged(ordered.mapInArrow(step, ", ".join([_LOCKSTEP, *[f"{c} {t}" for c, t in kept.items()]])), "lockstep")
    # the first words of a range's first phrase: at most three rows for each range, whatever the size of the table
    open_rows = stepped.where("f IS NULL")
    rows = stepped.where("f IS NOT NULL")
    counts = rows.select("lang", "words", F.col("f").alias("found")).join(F.broadcast(open_rows.select("part", "lang", "words")), ["lang", "words"])
    earlier = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.size("words"), "found"))).alias("earlier"))
    later = open_rows.groupBy("lang", "words").agg(F.max("longer").alias("later"))
    heads = F.transform("heads", lambda f, i: F.coalesce(f, F.col("earlier")[i + 1]))
    return (
        rows.join(F.broadcast(staged(earlier, "earlier")), "part", "left")
        .join(F.broadcast(staged(later, "later")), ["lang", "words"], "left")
        .select("lang", "words", "f", heads.alias("heads"), F.greatest("longer", F.coalesce("later", F.lit(0))).alias("longer"), *kept)
    )


def _cut(k: Column, settings: CollocationSettings) -> Column:
    """Score of the cut after k words; exact, and at most half of the scale."""
    left = F.get(F.col("heads"), k - 1)
    right = F.get(F.col("tails"), F.size("words") - k - 1)
    whole = F.col("f").cast("decimal(20,0)") * F.lit(settings.scale).cast("decimal(8,0)")
    score = F.call_function("div", whole, (left.cast("decimal(20,0)") + right.cast("decimal(20,0)")))
    return F.struct(score.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))


def collocations(
    docs: DataFrame, settings: CollocationSettings = CollocationSettings(), text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut
    that scores lowest (of equal scores after the fewest words), ``n`` the words
    of the language.  Phrases that a longer frequent phrase mostly holds are
    dropped: as counts fall with length, those with one word more decide.  A
    null text is empty; a null language is ``no_language``; a text without words,
    an empty table or a language without frequent phrases gives no row; repeated
    rows count each.
    """
    blocks = word_blocks(docs, text, lang, settings.no_language)
    phrases = frequent_phrases(blocks, settings)
    backward = lockstep(phrases.withColumn("words", F.reverse("words")))
    tails = backward.select(
        "lang", F.reverse("words").alias("words"), "f", F.col("heads").alias("tails"), F.col("longer").alias("before")
    )
    both = lockstep(tails, {"tails": "array<long>", "before": "long"})
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: _cut(k, settings))
    longest = F.greatest("longer", "before").cast("decimal(20,0)")
    held = (longest >= settings.least) & (longest * 100 >= F.col("f").cast("decimal(20,0)") * settings.held_percent)
    scored = both.where((F.size("words") > 1) & ~held).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(cuts).alias("cut")
    )
    ranking = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= settings.top)
    totals = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(
        F.sum("t.lang_words").alias("n")
    )
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
