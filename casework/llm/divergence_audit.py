"""How far the sources of a language diverge in their words.

Counting is an Arrow compute pipeline inside mapInArrow: ascii_lower,
split_pattern_regex, dictionary_encode, then hash group_by over (document, term) and over
(group, term), so a task leaves one row for each group and term that it met. A task's
partial counts are merged when they reach ``HELD`` rows and put out when merging does
not help, so its memory does not follow its input. Spark sums the partial counts;
a hot language, source or word reaches the shuffle as one row a task.

A language keeps the terms that at least ``least`` of its documents hold. A group's
smoothed frequency of a kept term is 1 + floor(SCALE * (count + 5) / (N + 5 V)), with N the
group's occurrences of kept terms and V their number; all of it in decimals and integers.

The divergence of two sources is the sum of absolute differences over all kept
terms. Terms are dealt to shards; a shard gets its nonzero frequencies and the
language's list of sources with the frequency of an absent term. It fills columnar
blocks of terms x sources one after the other and adds up the differences of all pairs of
sources; Spark sums the shards. Languages with more than ``TILE`` sources are dealt
by pairs of tiles of sources too, so neither a block nor its sums grow with them.

Null text, lang and source count as empty text. Groups whose documents have no term at all
are groups still. Rows that repeat count each; a row is a document, whatever its id. An
empty table gives an empty result. Ties in value rank by the item's UTF-8 bytes. Long texts are
read whole. Only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import in_parts, written
from casework.session import ship_package

#: Between terms: everything but letters and what lies beyond ASCII, once A-Z are lower-cased.
BREAK = r"[\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Rows of partial counts that a task holds.
HELD = 400_000
#: Sources of one tile, nonzero frequencies of one shard, numbers in one block.
TILE, SHARD, BLOCK = 1024, 25_000, 2_000_000

_KEYS = ["lang", "source", "term"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of every (lang, source, term) of a batch with
    columns lang, source, text. A group's own row has a null term."""
    langs, sources = (pc.dictionary_encode(pc.fill_null(c, "")) for c in batch.columns[:2])
    groups = pc.add(pc.multiply(langs.indices.cast(pa.int64()), max(1, len(sources.dictionary))), sources.indices.cast(pa.int64()))
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column(2), "")), pattern=BREAK)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    terms, rows = pc.dictionary_encode(words.filter(full)), rows.filter(full)
    # First by document, which gives the number of documents of a term.
    held = pa.table({"row": rows, "term": terms.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    held = pa.table({"group": groups.take(held["row"]), "term": held["term"], "n": held["count_all"]})
    held = held.group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
    width = max(1, len(sources.dictionary))
    lang_of = lambda g: langs.dictionary.take(pc.divide(g, width))
    source_of = lambda g: sources.dictionary.take(pc.subtract(g, pc.multiply(pc.divide(g, width), width)))
    met = pc.unique(groups)
    zeros = pa.array(np.zeros(len(met), dtype=np.int64))
    own = pa.table([lang_of(met), source_of(met), pa.nulls(len(met), pa.string()), zeros, zeros], schema=_COUNTS)
    group = held["group"].combine_chunks()
    counted = pa.table([lang_of(group), source_of(group), terms.dictionary.take(held["term"].combine_chunks()),
                        held["n_sum"].cast(pa.int64()), held["n_count"].cast(pa.int64())], schema=_COUNTS)
    return pa.concat_tables([own, counted])


def merged_counts(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("df", "sum")])
    return pa.table([out[c] for c in (*_KEYS, "n_sum", "df_sum")], schema=_COUNTS)


def partial_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, most: int = HELD) -> DataFrame:
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in in_parts([batch]):
                held.append(batch_counts(part))
                if sum(t.num_rows for t in held) > most:
                    held = [merged_counts(held)]
                    if held[0].num_rows > most // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from merged_counts(held).to_batches()

    columns = [F.col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, df long")


def _frequency(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count) + F.lit(5).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = wide(total) + wide(terms) * F.lit(5).cast("decimal(1,0)")
    return F.call_function("div", above, below) + 1


class _Shard:
    """The sums of one shard: sources in order of number, the frequencies of
    absent terms, and the nonzero frequencies that are yet to be added."""

    def __init__(self, key: tuple, size: int, block: int):
        self.key, self.size, self.block = key, size, block
        self.listed, self.ids = [], None
        self.cells: list[tuple[np.ndarray, ...]] = []
        self.terms = self.added = 0

    def _start(self) -> None:
        self.ids = np.concatenate([i for i, _ in self.listed])
        self.absent = np.concatenate([p for _, p in self.listed])
        self.sums = np.zeros((len(self.ids), len(self.ids)), dtype=np.int64)
        self.most = max(1, self.block // len(self.ids))

    def add(self, numbers: np.ndarray, sources: np.ndarray, p: np.ndarray) -> None:
        """Rows in order: the sources themselves (number -1) before the frequencies by term."""
        n = int(np.searchsorted(numbers >= 0, True))
        if n:
            self.listed.append((sources[:n], p[:n]))
        if n == len(numbers):
            return
        if self.ids is None:
            self._start()
        numbers = numbers[n:]
        self.cells.append((numbers, np.searchsorted(self.ids, sources[n:]), p[n:]))
        self.terms += int((numbers[1:] != numbers[:-1]).sum()) + 1
        if self.terms > self.most:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        """Add the gathered terms, but for the last one unless it is ``whole``."""
        numbers, at, p = (np.concatenate(c) for c in zip(*self.cells))
        cut = len(numbers) if whole else int(np.searchsorted(numbers, numbers[-1]))
        if not cut:  # one term so far, met in several batches
            self.cells, self.terms = [(numbers, at, p)], 1
            return
        rows = np.cumsum(np.append(True, numbers[1:cut] != numbers[:cut - 1])) - 1
        a = 0
        while a < cut:
            b = int(np.searchsorted(rows, rows[a] + self.most))
            dense = np.repeat(self.absent[None], rows[b - 1] - rows[a] + 1, axis=0)
            dense[rows[a:b] - rows[a], at[a:b]] = p[a:b]
            self.added += len(dense)
            for i in range(len(self.ids) - 1):
                self.sums[i, i + 1:] += np.abs(dense[:, i + 1:] - dense[:, i:i + 1]).sum(0)
            a = b
        self.cells, self.terms = ([], 0) if whole else ([(numbers[cut:], at[cut:], p[cut:])], 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.ids is None:
            self._start()
        if self.cells:
            self._flush(whole=True)
        lang, _, tile_i, tile_j = self.key
        tile = self.ids // self.size
        for i in range(len(self.ids)):
            # Of two tiles, only pairs across them; pairs within a tile are its own.
            j = np.flatnonzero((tile != tile[i]) | (tile_i == tile_j))
            j = j[j > i]
            if len(j):
                more = self.sums[i, j] - self.added * np.abs(self.absent[j] - self.absent[i])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(j), pa.string()), pa.array(np.full(len(j), self.ids[i])), pa.array(self.ids[j]),
                                                  pa.array(more)], names=["lang", "i", "j", "value"])


def _shard_sums(frame: DataFrame, size: int, block: int) -> DataFrame:
    """lang, i, j, value: over the shard's terms, the differences of the sources
    i < j beyond what they would be were the term in neither; terms that none of a tile
    pair's sources has thus add nothing there. ``frame`` is dealt and sorted by lang, shard, tile_i, tile_j, number, source_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "tile_i", "tile_j"))))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "source_id", "p")]
            begins = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
            for a, b in zip(begins, [*begins[1:], len(keys)]):
                if shard is None or shard.key != keys[a]:
                    if shard is not None:
                        yield from shard.rows()
                    shard = _Shard(keys[a], size, block)
                shard.add(*(c[a:b] for c in columns))
        if shard is not None:
            yield from shard.rows()

    return frame.mapInArrow(run, "lang string, i long, j long, value long")


def pair_sums(kept: DataFrame, groups: DataFrame, shard_rows: int = SHARD, size: int = TILE, block: int = BLOCK) -> DataFrame:
    """lang, i, j, value for all pairs i < j of a language's sources (numbers).
    A shard has about ``shard_rows`` frequencies, or as many as it gives sums, a tile ``size`` sources, a block about ``block`` numbers.

    ``groups``: lang, source_id, absent (frequency of a term without occurrences), sources, terms (of the language).
    ``kept``: lang, number (of the term), source_id, p of all nonzero counts.
    """
    listed = groups.join(kept.groupBy("lang").agg(F.count("*").alias("cells")), "lang", "left")
    sums = F.least("sources", F.lit(size)) * F.least("sources", F.lit(size)) / 2
    shards = F.ceil(F.col("cells") / F.greatest(F.lit(shard_rows), sums)).cast("int")
    listed = listed.withColumn("shards", F.coalesce(shards, F.lit(1))).drop("cells")
    tile = F.floor(F.col("source_id") / F.lit(size)).cast("int")
    tiles = F.floor((F.col("sources") - 1) / F.lit(size)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles), lambda t: F.struct(F.least(t, tile).alias("tile_i"), F.greatest(t, tile).alias("tile_j")))
    dealt = lambda df: df.withColumn("pair", F.explode(pairs)).select("lang", "shard", "pair.tile_i", "pair.tile_j", "number", "source_id", "p")
    heads = listed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumns({"number": F.lit(-1).cast("long"), "p": F.col("absent")})
    sizes = sized(written(listed.select("lang", "shards", "sources").distinct(), "shard-counts"))
    cells = kept.join(sizes, "lang").withColumn("shard", F.pmod("number", F.col("shards")).cast("int"))
    order = ["lang", "shard", "tile_i", "tile_j"]
    frame = dealt(heads).unionAll(dealt(cells)).repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order, "number", "source_id")
    beyond = _shard_sums(frame, size, block).groupBy("lang", "i", "j").agg(F.sum("value").alias("beyond"))
    side = lambda at, *more: sized(groups.select("lang", F.col("source_id").alias(at), F.col("absent").alias(f"absent_{at}"), *more))
    sums = beyond.join(side("i", "terms"), ["lang", "i"]).join(side("j"), ["lang", "j"])
    neither = F.col("terms") * F.abs(F.col("absent_i") - F.col("absent_j"))
    return sums.select("lang", "i", "j", (F.col("beyond") + neither).alias("value"))


def sized(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df``, to be broadcast if its values take at most ``most`` bytes by sum;
    else the join shuffles. Both give the same rows. ``df`` should be a written table."""
    width = lambda f: F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8)
    total = df.agg(F.sum(sum((width(f) for f in df.schema.fields), F.lit(8)))).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


def divergences(docs: DataFrame, least: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text", held: int = HELD, **limits: int) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language and the divergence from it, all ranks. Part ``term``: the terms that the
    source uses more than its language does, by excess frequency, ranks to ``top``. ``held`` and ``limits`` (see :func:`pair_sums`) bound
    memory and change no result.
    """
    counts = partial_counts(docs, lang_col, source_col, text_col, held).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = written(counts, "term-counts")
    words = counts.where("term is not null")
    terms = words.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= least)
    terms = written(terms.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("number")), "kept-terms")
    kept = written(words.drop("df").join(terms, ["lang", "term"]), "kept-counts")

    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counts.where("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", zero("terms"), zero("lang_total"), zero("total"),
                           (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("source_id"),
                           F.count("*").over(Window.partitionBy("lang")).alias("sources"))
    absent = F.when(F.col("terms") > 0, _frequency(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0))
    groups = written(groups.withColumn("absent", absent), "groups")

    known = sized(groups.select("lang", "source", "source_id", "terms", "lang_total", "total"))
    share = kept.join(known, ["lang", "source"]).select(
        "lang", "source", "source_id", "term", "number", _frequency(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _frequency(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    share = written(share, "frequencies")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())))
    excess = share.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    excess = ranked(excess).where(F.col("rank") <= top)

    sums = written(pair_sums(share.select("lang", "number", "source_id", "p"), groups.select("lang", "source_id", "absent", "sources", "terms"), **limits), "pair-sums")
    both = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    pairs = sums.select("lang", both.alias("pair"), "value").select("lang", "pair.a", "pair.b", "value")
    name = lambda at, out: sized(groups.select("lang", F.col("source_id").alias(at), F.col("source").alias(out)))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionAll(excess)
