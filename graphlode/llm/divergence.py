"""Which sources of a language use other words than the rest: all pairs of sources, and each source's own terms.

Every (lang, source) group has a smoothed distribution over the terms of its language: p = 1 + floor(10^9 (count + 1) / (N + V)). The
distance of group g from h is the sum over all V terms of f(p, q) = floor((p - q)^2 / q). Nobody walks all terms for all pairs. As p
depends on the count alone, inclusion and exclusion over the two supports gives the same sum:

* a histogram of each group's counts prices the terms that it has against the other group's p of a count of zero, both ways;
* a join of the postings, sparse as it is, corrects what both groups have: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0);
* all other terms cost the constant f(p0, q0).

All arithmetic is on integers, sums are decimals. Tasks count words into tables of bounded size before anything is shuffled, so a source with a third
of all rows is a few rows of each task. The posting join has at most one row for each pair of sources that share a term.

Defined results: null lang, source and text are empty strings; rows without any term still make their group; repeated rows count
each time; a language with one source has no pairs; without kept terms every pair is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_batches
from .common import staged

#: Runs of letters A-Z and of anything beyond ASCII, as UTF-8 bytes after A-Z is lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Entries of a task's table of counts, and bytes of a text that are looked through at a time.
HELD, LONG = 200_000, 1 << 20
UNIT = 1_000_000_000
COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(data: bytes) -> Counter:
    """Terms of a text in UTF-8 with their counts."""
    data = data.lower()  # of bytes: A-Z alone
    if len(data) <= LONG:
        return Counter(_TERM.findall(data))
    return Counter(m[0] for m in _TERM.finditer(data))


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group; a row of the empty term for every group that occurs."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        held = 0

        def flush():
            for (lang, source), terms in groups.items():
                words = [b"", *terms]
                n, d = [0, *(x[0] for x in terms.values())], [0, *(x[1] for x in terms.values())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                table = groups.setdefault((lang, source), {})
                before = len(table)
                for term, n in terms_of(text.as_py()).items():
                    entry = table.get(term)
                    if entry is None:
                        table[term] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                held += len(table) - before + 1
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return rows.mapInArrow(run, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str, v: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + v)), exactly."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} + {v} as decimal(20,0))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _sum(what: str) -> Column:
    return F.sum(F.expr(f"cast({what} as decimal(20,0))"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. part 'pair': distance from each other source of the language; 'term': the group's `top` most telling terms against its language."""
    counted = staged(count_terms(docs, lang_col, source_col, text_col), "term-counts")
    words = counted.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("d")).where(F.col("d") >= min_docs).drop("d")
    kept = staged(kept, "kept-terms")
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    postings = staged(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "postings")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = counted.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "terms", "v", "total_lang"])
    groups = staged(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0L", "total", "v"))), "groups")
    priced = postings.join(groups.select("lang", "source", "total", "v", "p0", "total_lang"), ["lang", "source"])
    priced = staged(priced.select("lang", "source", "term", _p("n", "total", "v").alias("p"), _p("n_lang", "total_lang", "v").alias("q"), "p0"), "priced")
    return _pairs(priced, groups).unionByName(_terms(priced, top))


def _terms(priced: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).cast("long").alias("value"))
    return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    side = lambda x: groups.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p0", "terms", "v")))
    base = side("g").join(side("h").drop("v_h"), "lang").where("source_g <> source_h")

    # the terms that one group has, priced by the other's p of no occurrence
    bins = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))
    other = groups.where("v > 0").select("lang", F.col("source").alias("other"), F.col("p0").alias("z"))
    met = bins.join(other, "lang").where("source <> other")
    alone = met.groupBy("lang", "source", "other").agg(_sum(f"c * ({_f('p', 'z')})").alias("as_g"), _sum(f"c * ({_f('z', 'p')})").alias("as_h"))
    alone = alone.selectExpr("lang", "stack(2, source, other, as_g, other, source, as_h) as (source_g, source_h, value)")

    # what both have
    own = lambda x: priced.select("lang", "term", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")))
    both = own("a").join(own("b"), ["lang", "term"]).where("source_a < source_b")

    def correction(x: str, y: str) -> Column:
        return _sum(f"({_f(f'p_{x}', f'p_{y}')}) - ({_f(f'p_{x}', f'p0_{y}')}) - ({_f(f'p0_{x}', f'p_{y}')}) + ({_f(f'p0_{x}', f'p0_{y}')})")

    shared = both.groupBy("lang", "source_a", "source_b").agg(correction("a", "b").alias("ab"), correction("b", "a").alias("ba"))
    shared = shared.selectExpr("lang", "stack(2, source_a, source_b, ab, source_b, source_a, ba) as (source_g, source_h, value)")

    parts = alone.unionByName(shared).groupBy("lang", "source_g", "source_h").agg(F.sum("value").alias("value"))
    neither = F.expr(f"cast(v_g - terms_g - terms_h as decimal(20,0)) * ({_f('p0_g', 'p0_h')})")
    value = F.when(F.col("v_g") > 0, F.coalesce("value", F.lit(0)) + neither).otherwise(F.lit(0)).cast("long")
    out = base.join(parts, ["lang", "source_g", "source_h"], "left").select("lang", F.col("source_g").alias("source"), F.lit("pair").alias("part"), F.col("source_h").alias("item"), value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.withColumn("rank", rank.cast("int"))
