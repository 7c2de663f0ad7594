"""Phrase search: BM25 over a corpus of pages or documents, ranked as if every posting were read.

``build_index`` makes one row per document with its term counts, in place.
``write_postings`` stores what a search reads.  Documents are numbered in order
of their host's labels from the top level down, so that a ``site:`` is one
interval of numbers; a stretch of numbers is a shard.  In each shard the
postings of a term are blocks in falling order of impact, each with its highest
impact and its first and last document.

A search weighs its terms and asks some shards for their best sums: the k-th best
of these is a threshold that no result scores less than.  Phrases with a site take the first
blocks of their weightiest terms instead.  Sums are made where a shard lies, many phrases at once, short lists of
postings first; the long ones are read only where they can lift a sum to the
threshold.  Each shard keeps the best rows of a phrase, and only these move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageflow.settings import SearchSettings
from pageflow.sources.shared import broadcast_if_small, fresh_path, remove, small_batches, staged

TOKEN_GAP = r"[^a-z0-9\x{c0}-\x{ff}]+"
SITE = r"(?i)(?:^|\s)site:(\S+)"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != "")


#: Bytes of the characters of ``TOKEN_GAP``'s complement; behind 0xC3, which begins U+00C0 to U+00FF, the next belongs to a term, too.
_TERM_BYTES = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), 0xC3])
#: Bytes of text whose terms are counted at once.
_COUNTED_BYTES = 2 << 20
_COUNTED = "struct<doc_length:int,postings:array<struct<term:string,tf:int>>>"


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of consecutive texts, null as empty."""
    _, bounds, data = texts.cast(pa.large_string()).buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(int(np.searchsorted(bounds, bounds[begin] + _COUNTED_BYTES, "right")) - 1, begin + 1)
        yield data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin]
        begin = end


def _term_counts(texts: pa.Array) -> pa.Array:
    """The number of terms of each lower-case text, and its terms in order with their counts; null for null."""
    lengths, sizes, terms, counts = [], [], [], []
    for data, offsets in _slices(texts) if len(texts) else ():
        held = _TERM_BYTES[data]
        held[1:] |= data[:-1] == 0xC3
        edges = np.diff(held.astype(np.int8), prepend=0)
        begins = edges == 1
        begins[offsets[:-1][np.diff(offsets) > 0]] |= held[offsets[:-1][np.diff(offsets) > 0]]
        at = np.flatnonzero(begins)
        owner = np.searchsorted(offsets, at, "right") - 1
        kept = np.concatenate([[0], np.cumsum(held)])
        bounds = np.append(kept[at], kept[-1]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data[held])).dictionary_encode()
        names = found.dictionary
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = np.sort(owner * len(order) + place[found.indices.to_numpy()])
        fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
        lengths.append(np.bincount(owner, minlength=len(offsets) - 1))
        counts.append(np.diff(np.append(fresh, len(keys))))
        keys = keys[fresh]
        sizes.append(np.bincount(keys // max(len(order), 1), minlength=len(offsets) - 1))
        terms.append(names.take(pa.array(order[keys % max(len(order), 1)])))
    if not lengths:
        return pa.nulls(len(texts), pa.struct([("doc_length", pa.int32()), ("postings", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))]))
    lost = texts.is_null()
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
    held = pa.StructArray.from_arrays([pa.concat_arrays(terms), pa.array(np.concatenate(counts).astype(np.int32))], ["term", "tf"])
    absent = pa.scalar(None, pa.list_(held.type))
    lists = pc.if_else(lost, absent, pa.ListArray.from_arrays(bounds, held)) if texts.null_count else pa.ListArray.from_arrays(bounds, held)
    length = pa.array(np.concatenate(lengths).astype(np.int32), mask=lost.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([length, lists], ["doc_length", "postings"])


def _counted(text: Column) -> Column:
    def count(texts: pa.Array) -> pa.Array:
        return _term_counts(texts)

    return F.arrow_udf(count, _COUNTED)(F.lower(text))


def build_index(corpus: DataFrame) -> DataFrame:
    """Index rows (doc_id, host, doc_length, postings) of (doc_id, host, text).

    Further columns of the corpus, such as url and title, stay in the index.
    """
    described = _counted(F.col("text").cast("string"))
    kept = [c for c in corpus.columns if c != "text"]
    return corpus.select(*kept, described.alias("d")).select(*kept, "d.*")


@dataclass(frozen=True)
class Postings:
    """A stored search index.

    ``documents``: doc_id, doc_no, host_key, doc_length and the corpus's further
    columns; ``blocks``: shard, term, leads, top, first_doc, last_doc, postings
    (doc_id, doc_no, impact); ``terms``: term, df, top.
    """

    documents: DataFrame
    blocks: DataFrame
    terms: DataFrame


def host_key(host: Column) -> Column:
    """A host's labels from the top level down, each ended by a dot: what lies below a domain begins with its key."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


_BLOCK = (
    "shard int, term string, leads boolean, top double, first_doc long, last_doc long, held int,"
    " postings array<struct<doc_id:long,doc_no:long,impact:double>>"
)
#: Columns of a document that its shard's blocks are made of.
_PACKED = ("shard", "doc_id", "doc_no", "norm", "terms", "tfs")


def _indexed_shards(described: list[str], settings: SearchSettings, block_schema: pa.Schema, document_schema: pa.Schema):
    """Rows of whole shards, in order, to their documents and then to their posting blocks."""
    fields = [f.name for f in block_schema]

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held)
        counts = pc.fill_null(pc.list_value_length(whole["tfs"]), 0).to_numpy()
        total = int(counts.sum())
        if not total:
            return None
        names = pa.concat_arrays([pc.split_pattern(t, " ").flatten() for t in whole["terms"].filter(pa.array(counts > 0)).chunks])
        names = names.dictionary_encode()
        rank = np.empty(len(names.dictionary), np.int32)
        rank[order := pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
        code = rank[names.indices.to_numpy()]
        tf = pa.concat_arrays([t.flatten() for t in whole["tfs"].chunks]).to_numpy()
        row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        norm = whole["norm"].to_numpy()[row]
        impact = tf * (settings.k1 + 1) / (tf + norm)
        by = np.lexsort((row, -impact, code))
        code, row, impact = code[by], row[by], impact[by]
        fresh = np.concatenate([[True], code[1:] != code[:-1]])
        runs = np.flatnonzero(fresh)
        sizes = np.diff(np.append(runs, total))
        starts = np.flatnonzero((np.arange(total) - np.repeat(runs, sizes)) % settings.block_postings == 0)
        number = whole["doc_no"].to_numpy()[row]
        ids = whole["doc_id"].combine_chunks().take(pa.array(row))
        postings = pa.StructArray.from_arrays([ids, pa.array(number), pa.array(impact)], names=["doc_id", "doc_no", "impact"])
        leads = fresh[starts]
        df = np.zeros(len(starts), np.int32)
        df[leads] = sizes
        columns = [
            pa.array(np.full(len(starts), whole["shard"][0].as_py(), np.int32)),
            names.dictionary.take(pa.array(order[code[starts]])), pa.array(leads), pa.array(impact[starts]),
            pa.array(np.minimum.reduceat(number, starts)), pa.array(np.maximum.reduceat(number, starts)), pa.array(df, mask=~leads),
            pa.ListArray.from_arrays(pa.array(np.append(starts, total).astype(np.int32)), postings),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, block_schema)], names=fields)

    def row_of(table: str, block: pa.RecordBatch | None, document: pa.RecordBatch | None) -> pa.RecordBatch:
        n = len(block if block is not None else document)
        parts = [
            pa.nulls(n, pa.struct(list(schema))) if held is None else pa.StructArray.from_arrays(held.columns, fields=list(schema))
            for held, schema in ((block, block_schema), (document, document_schema))
        ]
        return pa.RecordBatch.from_arrays([pa.array([table] * n), *parts], names=["table", "block", "document"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            yield row_of("documents", None, pa.RecordBatch.from_arrays([batch.column(c).cast(f.type) for c, f in zip(described, document_schema)], names=described))
            held.append(batch.select(list(_PACKED)))
        if held and (done := blocks(held)) is not None:
            for at in range(0, len(done), 2_000):
                yield row_of("blocks", done.slice(at, 2_000), None)

    return run


def write_postings(index: DataFrame, path: str, settings: SearchSettings = SearchSettings()) -> Postings:
    """Store the posting blocks of a ``build_index`` table below ``path``.

    The index is made once and written down, as ranges are found by a first pass over their
    input.  It moves once, without texts, by host key for its numbers; a range is a shard,
    whose blocks are made where it lies.  Ranges spread a host with a third of all rows over tasks.
    """
    spark = index.sparkSession
    small_batches(spark)
    order = ["host_key", "doc_id"]
    index.write.parquet(f"{path}/rows")
    rows = spark.read.schema(index.schema).parquet(f"{path}/rows")
    n_docs, mean_length = rows.agg(F.count(F.lit(1)), F.avg("doc_length")).first()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(min(most, max(2 * spark.sparkContext.defaultParallelism, -(-n_docs // settings.shard_documents))), 1)
    norm = settings.k1 * (1 - settings.b + settings.b * F.col("doc_length") / mean_length)
    # terms hold no blank; one string and one array are far shorter than an array of rows
    packed = rows.withColumns(
        {
            "host_key": host_key(F.col("host")),
            "norm": norm,
            "terms": F.array_join("postings.term", " "),
            "tfs": F.col("postings.tf"),
        }
    ).drop("host", "postings")
    ordered = packed.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)
    numbered = ordered.withColumns({"doc_no": F.monotonically_increasing_id(), "shard": F.spark_partition_id()})
    described = [c for c in numbered.columns if c not in ("norm", "terms", "tfs")]
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in numbered.select(*described).schema)
    schema = StructType.fromDDL(_BLOCK)
    made = numbered.mapInArrow(
        _indexed_shards(described, settings, to_arrow_schema(schema), to_arrow_schema(numbered.select(*described).schema)),
        f"table string, block {schema.simpleString()}, document struct<{kinds}>",
    )
    made.write.parquet(f"{path}/made")
    remove(spark, f"{path}/rows")
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    made = spark.read.parquet(f"{path}/made")
    documents = made.where("table = 'documents'").select("document.*")
    blocks = made.where("table = 'blocks'").select("block.*")
    terms = blocks.where("leads").groupBy("term").agg(F.sum("held").alias("df"), F.max("top").alias("top"))
    return Postings(documents, blocks.drop("held"), terms)


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """(query_id, site, term, any others but the phrase) of (query_id, phrase, ...); ``site:`` is no term, no site is ``''``."""
    site = F.lower(F.regexp_extract("phrase", SITE, 1))
    words = F.regexp_replace("phrase", SITE, " ")
    others = [c for c in phrases.columns if c not in ("query_id", "phrase")]
    return phrases.select(
        "query_id", *others, site.alias("site"), F.explode(F.array_distinct(terms_of(words))).alias("term")
    )


_ALL = (0, (1 << 63) - 1)


def site_intervals(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """(site, low, high) of (site): the documents below a site are those with low <= doc_no < high.

    A merge of two sorted tables: a site's key and the key right behind all it
    holds are sorted in among the documents' host keys, and each takes the next
    document's number.  Numbers are found within ranges; where a range has no
    further document, the first of a later range counts, one row a range.
    """
    key = host_key(F.col("site"))
    # "/" comes right after "."
    after = F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/"))
    keys = sites.select("site", key.alias("k"))
    bounds = keys.select("site", F.lit("low").alias("bound"), F.col("k").alias("key")).unionByName(
        keys.select("site", F.lit("high").alias("bound"), after.alias("key"))
    )
    hosts = documents.groupBy(F.col("host_key").alias("key")).agg(F.min("doc_no").alias("doc_no"))
    both = bounds.unionByName(hosts, allowMissingColumns=True).repartitionByRange("key")
    parted = staged(both.withColumn("part", F.spark_partition_id()), "site-bounds")
    following = Window.partitionBy("part").orderBy("key").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = parted.groupBy("part").agg(F.min("doc_no").alias("part_first"))
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # one row a range
    firsts = firsts.select("part", F.min("part_first").over(later).alias("part_next"))
    placed = parted.withColumn("next", F.min("doc_no").over(following)).where("site IS NOT NULL").join(F.broadcast(firsts), "part")
    place = F.coalesce("next", "part_next", F.lit(_ALL[1]))
    bound = lambda name: F.max(F.when(F.col("bound") == name, place)).alias(name)
    return placed.groupBy("site").agg(bound("low"), bound("high"))


def _weights(wanted: DataFrame, index: Postings) -> DataFrame:
    """Phrase terms with idf, the most the term can give (``most``), the most all others can (``rest``), and intervals.

    The inverse document frequency is above 0 for every term, so that a phrase
    of words that stand in nearly all documents has results, too.
    """
    n_docs = index.documents.count()
    weight = F.ln(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = wanted.join(index.terms, "term").withColumn("idf", weight).withColumn("most", F.col("idf") * F.col("top"))
    query = Window.partitionBy("query_id")
    found = found.select(
        "query_id", "wanted", "site", "term", "idf", "most",
        (F.sum("most").over(query) - F.col("most")).alias("rest"),
        F.row_number().over(query.orderBy(F.desc("most"), "term")).alias("weight_rank"),
    )
    sites = staged(wanted.where("site <> ''").select("site").distinct(), "sites")
    if sites.isEmpty():
        return found.withColumns({"low": F.lit(_ALL[0]).cast("bigint"), "high": F.lit(_ALL[1])}).drop("site")
    bounded = found.join(site_intervals(sites, index.documents), "site", "left")
    free = lambda name, value: F.when(F.col("site") == "", F.lit(value).cast("bigint")).otherwise(F.col(name))
    return bounded.withColumns({"low": free("low", _ALL[0]), "high": free("high", _ALL[1])}).drop("site")


_SUMS = "query_id long, doc_id long, score double, kind long"
_CLOSE = 2e-6  # scores are rounded
#: Sums of phrases and documents that are made at once, and phrases that take part at most.
_CELLS, _PHRASES = 1 << 18, 1 << 10
#: Share of the threshold up to which long lists wait until the others are summed.
_LATER = 0.7


class _Shard:
    """The asked postings of one shard by their term: long lists as rows of a matrix, too.

    ``kinds``, if any: numbers of the documents that count, and their kinds, of which the best one counts.
    """

    def __init__(
        self, term: np.ndarray, weight: np.ndarray, sizes: np.ndarray, ids: np.ndarray, numbers: np.ndarray, impacts: np.ndarray,
        kinds: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> None:
        self.base = int(numbers.min())
        self.size = int(numbers.max()) - self.base + 1
        place = (numbers - self.base).astype(np.int32)
        self.ids = np.zeros(self.size, np.int64)
        self.ids[place] = ids
        self.terms, code = np.unique(term, return_inverse=True)
        code = np.repeat(code.astype(np.int32), sizes)
        gain = np.repeat(weight, sizes) * impacts
        self.kind, self.one_each = np.arange(self.size), True
        if kinds is not None:
            own = kinds[0] - self.base
            held = (own >= 0) & (own < self.size)
            self.kind = np.full(self.size, -1)
            self.kind[own[held]] = kinds[1][held]
            counts = self.kind[place] >= 0
            code, place, gain = code[counts], place[counts], gain[counts]
            # places by kind, those that don't count first
            self.by_kind = np.argsort(self.kind, kind="stable")
            ordered = self.kind[self.by_kind]
            self.kind_starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            self.one_each = len(np.unique(own[held])) == len(np.unique(kinds[1][held]))
        order = np.argsort(code, kind="stable")
        code, self.place, self.gain = code[order], place[order], gain[order]
        self.starts = np.searchsorted(code, np.arange(len(self.terms) + 1))
        full = np.flatnonzero(np.diff(self.starts))
        self.tops = np.zeros(len(self.terms))
        if len(full):
            self.tops[full] = np.maximum.reduceat(self.gain, self.starts[full])
        long = np.flatnonzero(np.diff(self.starts) * 8 > self.size)
        self.row = np.full(len(self.terms), -1)
        self.row[long] = np.arange(len(long))
        self.matrix = np.zeros((len(long), self.size))
        for row, t in enumerate(long):
            at = slice(self.starts[t], self.starts[t + 1])
            self.matrix[row, self.place[at]] = self.gain[at]

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term among the shard's terms, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def _short(self, phrase: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Sums of the lists of (phrase, term) pairs: a row for each of ``n`` phrases."""
        sizes = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.zeros((n, self.size))
        at = np.arange(total) + np.repeat(self.starts[term] - ends + sizes, sizes)
        cells = np.repeat(phrase * self.size, sizes) + self.place[at]
        return np.bincount(cells, self.gain[at], n * self.size).reshape(n, self.size)

    def _added(self, phrase: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The same without what lies beyond [first, last) of the phrases ``cut``."""
        sums = self._short(phrase, term, len(first))
        for i in np.flatnonzero(cut):
            sums[i, : first[i]] = -np.inf
            sums[i, last[i] :] = -np.inf
        return sums

    def _least(self, sums: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of each row the ``most``-th best sum of different kinds, or 0: no document of the result scores less in the end."""
        if not self.one_each:
            sums = np.maximum.reduceat(sums[:, self.by_kind], self.kind_starts, axis=1)
        most = np.minimum(most, sums.shape[1] + 1)
        least = np.zeros(len(most))
        for k in np.unique(most):
            if k <= sums.shape[1]:
                rows = most == k
                least[rows] = np.maximum(np.partition(sums[rows], sums.shape[1] - k, axis=1)[:, sums.shape[1] - k], 0.0)
        return least

    def best(
        self, phrase: np.ndarray, term: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: np.ndarray, most: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, place, sum) within [low, high), of at least the threshold: the best ``most`` kinds of each phrase and what rounding may put among them.

        ``phrase`` and ``term`` are pairs of numbers, sorted by phrase; the others have a value for each phrase.
        """
        n = len(low)
        tops = np.bincount(phrase, self.tops[term], n)
        live = (tops > 0) & (tops >= threshold - _CLOSE)
        phrase, term = phrase[live[phrase]], term[live[phrase]]
        first, last = np.clip(low - self.base, 0, self.size), np.clip(high - self.base, 0, self.size)
        cut = live & ((first > 0) | (last < self.size))
        rows = self.row[term]
        if (free := live & (threshold <= 0)).any():
            some = free[phrase] & (rows < 0)
            sums = self._added(phrase[some], term[some], first, last, cut)
            threshold = threshold.copy()
            threshold[free] = self._least(sums[free], most[free])
        threshold = np.where(live, threshold - _CLOSE, np.inf)
        # long lists that cannot make up the threshold are left for later, the others summed with the short ones
        pairs = np.flatnonzero(rows >= 0)
        pairs = pairs[np.lexsort((self.tops[term[pairs]], phrase[pairs]))]
        of, top = phrase[pairs], self.tops[term[pairs]]
        ahead = np.cumsum(top)
        begin = np.searchsorted(of, np.arange(n))
        ahead -= np.concatenate([[0.0], ahead])[begin][of]
        later = ahead <= _LATER * threshold[of]
        now = np.ones(len(phrase), bool)
        now[pairs[later]] = False
        sums = self._added(phrase[now], term[now], first, last, cut)
        if free.any():
            threshold[free] = np.maximum(threshold[free], self._least(sums[free], most[free]) - _CLOSE)
        # the weightiest first: only where they can lift a sum to the threshold
        pairs, of, top = pairs[later][::-1], of[later][::-1], top[later][::-1]
        row, n_later = rows[pairs], np.bincount(of, minlength=n)
        begin = np.cumsum(n_later[::-1])[::-1] - n_later
        rest = np.bincount(of, top, n) + 0.0
        at = np.flatnonzero((sums >= (threshold - rest - 1e-9)[:, None]).ravel())
        sums, whose = sums.ravel()[at], at // self.size
        at -= whose * self.size
        for k in range(int(n_later.max(initial=0))):
            step = np.minimum(begin + k, len(row) - 1)
            more = k < n_later
            sums = sums + np.where(more[whose], self.matrix[row[step][whose], at], 0.0)
            rest = rest - np.where(more, top[step], 0.0)
            kept = np.flatnonzero(sums >= (threshold - rest - 1e-9)[whose])
            sums, whose, at = sums[kept], whose[kept], at[kept]
        kept = (sums > 0) & (self.kind[at] >= 0)
        return self._cut(whose[kept], at[kept], sums[kept], most)

    def _cut(self, whose: np.ndarray, at: np.ndarray, sums: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(whose):
            return whose, at, sums
        ids = self.ids[at]
        leads = np.ones(len(at), bool)  # the best of its kind
        if not self.one_each:
            kind = self.kind[at]
            order = np.lexsort((ids, -sums, kind, whose))
            whose, at, sums, ids, kind = whose[order], at[order], sums[order], ids[order], kind[order]
            leads = np.concatenate([[True], (whose[1:] != whose[:-1]) | (kind[1:] != kind[:-1])])
            again = np.concatenate([[False], (sums[1:] == sums[:-1]) & ~leads[1:]])  # equal sums of a kind: the smallest id
            best = sums[leads][np.cumsum(leads) - 1]
            kept = ~again & (sums >= best - _CLOSE)
            whose, at, sums, ids, leads = whose[kept], at[kept], sums[kept], ids[kept], leads[kept]
        order = np.lexsort((ids, -sums, whose))
        whose, at, sums, leads = whose[order], at[order], sums[order], leads[order]
        fresh = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        sizes = np.diff(np.append(fresh, len(whose)))
        run = np.cumsum(leads)
        place = run - np.repeat(run[fresh] - leads[fresh], sizes)  # kinds up to here
        last = np.full(len(most), -np.inf)
        ends = np.flatnonzero(leads & (place == most[whose]))
        last[whose[ends]] = sums[ends] - _CLOSE
        kept = sums >= last[whose]
        whose, at, sums = whose[kept], at[kept], sums[kept]
        # equal sums are rounded alike: of each value the smallest ids
        fresh = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (sums[1:] != sums[:-1])]))
        kept = np.arange(len(sums)) - np.repeat(fresh, np.diff(np.append(fresh, len(sums)))) < most[whose]
        return whose[kept], at[kept], sums[kept]


def _shard_sums():
    """Rows of a shard's documents, blocks, then of its phrases, to the best sums of each phrase in it."""

    def flat(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
        return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])

    def built(held: list[pa.RecordBatch]) -> _Shard | None:
        kinds = [b.filter(pc.is_valid(b.column("kind"))) for b in held]
        kinds = [b for b in kinds if len(b)]
        held = [b for b in (b.filter(pc.is_valid(b.column("term_id"))) for b in held) if len(b)]
        if not held:
            return None  # no block of an asked term
        values = lambda name: np.concatenate([b.column(name).flatten().to_numpy() for b in held])
        sizes = np.concatenate([pc.list_value_length(b.column("numbers")).to_numpy() for b in held])
        own = (flat(kinds, "number"), flat(kinds, "kind")) if kinds else None
        return _Shard(flat(held, "term_id"), flat(held, "idf"), sizes, values("ids"), values("numbers"), values("impacts"), own)

    def summed(ready: _Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        asked = part.column("term_ids")
        sizes = pc.list_value_length(asked).to_numpy()
        places = ready.places(asked.flatten().to_numpy())
        phrase = np.repeat(np.arange(len(part)), sizes)[places >= 0]
        values = [part.column(c).to_numpy() for c in ("low", "high", "threshold", "wanted")]
        whose, at, sums = ready.best(phrase, places[places >= 0], *values)
        queries = part.column("query_id").take(pa.array(whose))  # may be null
        columns = [queries, *map(pa.array, (ready.ids[at], sums, ready.kind[at]))]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SUMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, ready = [], None, None
        for batch in batches:
            number = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            phrase = batch.column("is_phrase").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (phrase[1:] != phrase[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(batch)]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if number[start] != shard:
                    held, shard, ready = [], number[start], None
                if not phrase[start]:
                    held.append(part)
                    continue
                if held:
                    ready, held = built(held), []
                if ready is None:
                    continue
                step = min(max(_CELLS // ready.size, 1), _PHRASES)
                for at in range(0, len(part), step):
                    if len(out := summed(ready, part.slice(at, step))):
                        yield out
        # the worker lives on
        del held, ready
        pa.default_memory_pool().release_unused()

    return run


def _summed(blocks: DataFrame, weights: DataFrame, settings: SearchSettings, kinds: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, kind) of at least the threshold, of each shard the best and what rounding may put among them.

    Blocks of asked terms move once, packed, to their shard, and phrases, as the
    numbers of their terms, to the shards of their interval; sums are made there.
    A phrase gets as many as it has ``wanted``, or ``top_k``.  With ``kinds`` (shard, doc_no, kind) only the documents named count, and of each kind one.
    Where there are few shards, the phrases of one are dealt to ``shard_copies`` of it.
    """
    n_tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "wanted" not in weights.columns:
        weights = weights.withColumn("wanted", F.lit(settings.top_k).cast("bigint"))
    # numbers of four bytes: a row's place in its partition, and the partition
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) * n_tasks + F.spark_partition_id()
    numbered = weights.groupBy("term").agg(F.first("idf").alias("idf")).withColumn("term_id", place.cast("int"))
    numbers = broadcast_if_small(staged(numbered, "vocabulary"), settings.broadcast_bytes)
    # sorted numbers, so that sums are made in the same order everywhere
    phrases = staged(
        weights.join(numbers.drop("idf"), "term").groupBy("query_id").agg(
            F.sort_array(F.collect_list("term_id")).alias("term_ids"),
            *[F.first(c).alias(c) for c in ("low", "high", "threshold")],
            F.max("wanted").alias("wanted"),
        ),
        "phrases",
    )
    shards = staged(blocks.groupBy("shard").agg(F.min("first_doc").alias("first"), F.max("last_doc").alias("last")), "shards")
    # the intervals, one for all phrases without a site, with the shards they meet
    reached = phrases.select("low", "high").distinct().join(F.broadcast(shards), (F.col("first") < F.col("high")) & (F.col("last") >= F.col("low")))
    reached = broadcast_if_small(staged(reached.select("low", "high", "shard"), "reached"), settings.broadcast_bytes)
    met = phrases.join(reached, ["low", "high"])
    asked = blocks.join(numbers, "term", "left_semi").join(numbers, "term")
    packed = [F.col(f"postings.{c}").alias(name) for c, name in (("doc_id", "ids"), ("doc_no", "numbers"), ("impact", "impacts"))]
    rows = asked.select("shard", F.lit(False).alias("is_phrase"), "term_id", "idf", *packed).unionByName(
        met.select("shard", F.lit(True).alias("is_phrase"), "query_id", "term_ids", "low", "high", "threshold", "wanted"),
        allowMissingColumns=True,
    )
    if kinds is None:
        rows = rows.withColumns({"number": F.lit(None).cast("bigint"), "kind": F.lit(None).cast("bigint")})
    else:
        own = kinds.select("shard", F.lit(False).alias("is_phrase"), F.col("doc_no").alias("number"), "kind")
        rows = rows.unionByName(own.join(F.broadcast(shards.select("shard")), "shard", "left_semi"), allowMissingColumns=True)
    by = ["shard"]
    rows = rows.withColumn("part", F.lit(0))
    if settings.shard_copies > 1:
        every = F.sequence(F.lit(0), F.lit(settings.shard_copies - 1))
        own = F.when(F.col("is_phrase"), F.array(F.pmod(F.xxhash64("query_id"), F.lit(settings.shard_copies)).cast("int"))).otherwise(every)
        rows = rows.withColumn("part", F.explode(own))
        by.append("part")
    # ranges, as hashes would put several of as many shards as tasks into one task
    placed = rows.repartitionByRange(n_tasks, *by).sortWithinPartitions(*by, "is_phrase", "term_id", "query_id")
    summed = placed.mapInArrow(_shard_sums(), _SUMS)
    return summed.withColumn("score", F.round("score", 6))


def search(
    phrases: DataFrame, index: Postings, settings: SearchSettings = SearchSettings(), kinds: DataFrame | None = None
) -> DataFrame:
    """The best documents of each phrase: (query_id, doc_id, score, rank).

    ``top_k`` of them, or where ``phrases`` has a column ``wanted`` at least so many, if it is less than ``top_k``.
    ``kinds`` (shard, doc_no, kind) names the documents that count, and of each kind the best one only,
    as if the others were not in the corpus; weights are those of the whole corpus.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def ranked(scored: DataFrame) -> DataFrame:
        if kinds is not None:
            of_kind = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "doc_id")
            # by query once, which both windows take
            scored = scored.repartition("query_id").withColumn("place", F.row_number().over(of_kind)).where("place = 1").drop("place")
        return scored.drop("kind").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= settings.top_k)

    small_batches(phrases.sparkSession)
    # what is read only until the sums are planned
    scratch = fresh_path(phrases.sparkSession, "search")
    wanted = F.least(F.col("wanted"), F.lit(settings.top_k)) if "wanted" in phrases.columns else F.lit(settings.top_k)
    weights = staged(_weights(phrase_terms(phrases.withColumn("wanted", wanted.cast("bigint"))), index), "weights", scratch)
    # the k-th best of a few from each of some shards is a threshold as well as that of all
    shards = sorted(r.shard for r in index.blocks.select("shard").distinct().collect())
    leading = shards[:: settings.shards_a_lead]
    few = lambda n: F.least("wanted", 1 + F.ceil(2 * F.col("wanted") / max(n, 1)))
    everywhere = (F.col("low") == _ALL[0]) & (F.col("high") == _ALL[1])
    some = weights.where(everywhere).withColumns({"threshold": F.lit(0.0), "wanted": few(len(leading))})
    tasks = index.blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-tasks // max(len(leading), 1)), 1)
    at = F.col("shard").isin(leading)
    led = staged(some, "lead-weights", scratch)
    own = [] if kinds is None else [kinds.where(at)]
    seen = _summed(index.blocks.where(at), led, replace(settings, shard_copies=parts), *own)
    own = [] if kinds is None else [kinds]
    within = weights.where(~everywhere & (F.col("weight_rank") <= settings.lead_terms))
    within = staged(within.withColumns({"threshold": F.lit(0.0), "wanted": few(len(shards))}), "lead-terms", scratch)
    if not within.isEmpty():
        seen = seen.unionByName(_summed(index.blocks.where("leads"), within, settings, *own))
    asked = weights.groupBy("query_id").agg(F.max("wanted").alias("wanted"))
    known = ranked(seen).join(asked, "query_id").where(F.col("rank") == F.col("wanted"))
    thresholds = staged(known.select("query_id", F.col("score").alias("threshold")), "thresholds")
    bounded = weights.join(thresholds, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    found = ranked(_summed(index.blocks, staged(bounded, "bounded-weights", scratch), settings, *own))
    remove(phrases.sparkSession, scratch)
    return found
