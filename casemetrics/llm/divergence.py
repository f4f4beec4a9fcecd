"""Source divergence audit: how differently the sources of a language use its terms.

Term counts are taken per (lang, source) group. Every language keeps the terms of enough of its
documents and numbers them, frequent ones first, so that 64 terms in a row fill one word of bits.
A group's terms of one count within a word are one bitset: a level. For two groups the AND of two
levels, counted, is the number of terms that have the one count here and the other there; times the
distance of the two shares it gives the part of these terms in the sum. Terms that a group lacks are
the complement of its levels and make one more level. Words are dealt out in chunks, a chunk gives
every pair of sources of its language a partial sum, and the partial sums add up by shuffle.

All arithmetic is exact: shares are whole numbers, computed in decimals. Null text, lang and source
read as empty strings. Repeated rows count one by one, with or without equal ids, which are not
read. A group without terms takes part with every count at zero; a language without kept terms
gives its pairs the value 0. An empty table gives an empty result; other columns are not read. What
is held in one task is bounded by the sources of a language times the terms of a chunk, never by
documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemetrics.llm.common import ship, stored, utf8
from casemetrics.operators.sizing import lookup_join

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Different terms that a task counts before it passes them on, and bytes of text it reads at once.
HELD_TERMS = 200_000
BLOCK_BYTES = 1 << 20
#: Levels of a chunk, at most, and sources whose pairs one task sums up.
CHUNK_LEVELS = 1 << 22
SLICE_SOURCES = 1024
CELLS = 1 << 20

TERM = re.compile(rb"[a-z\x80-\xff]+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
COUNTS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, source string, item string, value long"


def _text_terms(raw: bytes) -> Counter:
    """Counts of the terms of one text, read in blocks that end between terms."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        gap = BREAK.search(raw, at + BLOCK_BYTES)
        end = gap.start() if gap else len(raw)
        counts.update(TERM.findall(raw, at, end))
        at = end
    return counts


def _count_rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    """The held counts as rows; every group leaves one row without a term as well."""
    lang, source, terms, n, docs = [], [], [], [], []
    for (a, b), (times, texts) in held.items():
        lang += [a] * (len(times) + 1)
        source += [b] * (len(times) + 1)
        terms += [None, *times]
        n += [0, *times.values()]
        docs += [0, *(texts[t] for t in times)]
    columns = [lang, source, pa.array(terms, pa.binary()).cast(pa.string()), n, docs]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term by (lang, source); a null term marks the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for i, group in enumerate(groups):
                own = _text_terms(data[offsets[i] : offsets[i + 1]].tobytes().lower())
                times, texts = held.setdefault(group, (Counter(), Counter()))
                size -= len(times)
                times.update(own)
                texts.update(own.keys())
                size += len(times)
                if size > HELD_TERMS:
                    yield _count_rows(held)
                    held, size = {}, 0
        if held:
            yield _count_rows(held)

    ship(docs.sparkSession)
    plain = docs.select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    parts = plain.mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    above = f"(cast({count} as decimal(20, 0)) + {SMOOTHING}) * {SCALE}"
    below = f"nullif(cast({total} as decimal(20, 0)) + {SMOOTHING} * v, 0)"
    return F.expr(f"1 + ({above}) div ({below})")


def pair_sums(levels: pd.DataFrame, groups: pd.DataFrame, slices: int, slice_: int) -> pd.DataFrame:
    """Partial sums of one chunk: each source of the slice against all others of the language.

    ``levels`` holds word, source, p and bits; ``groups`` every source and its share p of count 0.
    """
    groups = groups.sort_values("source", ignore_index=True)
    names = groups["source"].to_numpy()
    n = len(names)
    own = np.arange(n) % slices == slice_
    slot = np.cumsum(own) - 1
    sums = np.zeros((int(own.sum()), n), np.int64)
    level_group = np.searchsorted(names, levels["source"].to_numpy())
    order = np.lexsort((level_group, levels["word"].to_numpy()))
    word = levels["word"].to_numpy()[order]
    level_group = level_group[order]
    level_p = levels["p"].to_numpy().astype(np.int64)[order]
    level_bits = levels["bits"].to_numpy().astype(np.int64).view(np.uint64)[order]
    edges = np.flatnonzero(np.diff(word, prepend=-1, append=-1))
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        at = slice(first, last)
        used = np.zeros(n, np.uint64)
        np.bitwise_or.at(used, level_group[at], level_bits[at])
        lacking = ~used & np.bitwise_or.reduce(used)
        group = np.concatenate([level_group[at], np.arange(n)])
        by_group = np.argsort(group, kind="stable")
        group = group[by_group]
        p = np.concatenate([level_p[at], groups["p"].to_numpy().astype(np.int64)])[by_group]
        bits = np.concatenate([level_bits[at], lacking])[by_group]
        columns = np.searchsorted(group, np.arange(n))
        rows = np.flatnonzero(own[group] & (bits != 0))
        step = max(1, CELLS // len(bits))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            cells = np.bitwise_count(bits[r, None] & bits[None, :])
            parts = cells * np.abs(p[r, None] - p[None, :])
            np.add.at(sums, slot[group[r]], np.add.reduceat(parts, columns, axis=1))
    source = np.repeat(names[own], n)
    item = np.tile(names, int(own.sum()))
    other = source != item
    return pd.DataFrame({"source": source[other], "item": item[other], "value": sums.ravel()[other]})


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Per (lang, source): ``pair`` rows, its distance to every other source of the language, and
    ``term`` rows, the terms that it uses most above the language; ``rank`` counts from 1."""
    counts = stored(term_counts(docs))
    by_term = counts.filter("term is not null").groupBy("lang", "term")
    frequent = by_term.agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_documents)
    order = [F.asc("lang"), F.desc("docs"), F.asc("term")]
    ordered = frequent.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ordered.select("lang", "term", "total", F.monotonically_increasing_id().alias("id")))
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "id"))

    groups = counts.filter("term is null").select("lang", "source")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    whole = groups.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left")
    totals = stored(whole.fillna(0, ["size", "v", "lang_size"]))
    shares = lookup_join(held, totals, ["lang", "source"], spread_by=["id"])
    shares = shares.withColumn("p", _share("n", "size"))

    pairs = _pairs(shares, kept, totals)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    above = shares.withColumn("value", F.col("p") - _share("total", "lang_size")).filter("n > 0 and value > 0")
    above = above.select("lang", "source", F.col("term").alias("item"), "value")
    top = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(top.withColumn("part", F.lit("term")))


def _pairs(shares: DataFrame, kept: DataFrame, totals: DataFrame) -> DataFrame:
    """The distance of every two sources of a language, summed over all kept terms."""
    most = totals.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunk_words = min(64, max(1, CHUNK_LEVELS // most // 64))
    slices = -(-most // SLICE_SOURCES)
    word = F.shiftright("id", 6)
    chunk = F.floor(word / chunk_words).cast("long")
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    levels = shares.groupBy("lang", "source", word.alias("word"), chunk.alias("chunk"), "p").agg(F.bit_or(bit).alias("bits"))
    chunks = kept.select("lang", chunk.alias("chunk")).distinct()
    none = totals.select("lang", F.lit(-1).cast("long").alias("chunk")).distinct()
    share_of_none = F.coalesce(_share("0", "size"), F.lit(1))
    zero = totals.select(
        "lang", "source", F.lit(-1).cast("long").alias("word"), share_of_none.alias("p"), F.lit(0).cast("long").alias("bits")
    )
    members = lookup_join(chunks.unionByName(none), zero, ["lang"], spread_by=["chunk"])
    rows = levels.unionByName(members)
    dealt = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        member = rows["word"] < 0
        found = pair_sums(rows[~member], rows.loc[member, ["source", "p"]], slices, int(rows["slice"].iloc[0]))
        return found.assign(lang=rows["lang"].iloc[0])[["lang", "source", "item", "value"]]

    partial = dealt.groupBy("lang", "chunk", "slice").applyInPandas(sums, PARTIAL)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents),
uses AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM uses JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
    SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN found f
        ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sized AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size, sum(n) OVER (PARTITION BY lang) AS lang_size,
        sum(n) OVER (PARTITION BY lang, term) AS total, count(*) OVER (PARTITION BY lang, source) AS v
    FROM grid),
shares AS (
    SELECT lang, source, term, n,
        1 + ((n + {SMOOTHING})::HUGEINT * {SCALE}) // (size + {SMOOTHING} * v)::HUGEINT AS p,
        1 + ((total + {SMOOTHING})::HUGEINT * {SCALE}) // (lang_size + {SMOOTHING} * v)::HUGEINT AS q
    FROM sized),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
    FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
