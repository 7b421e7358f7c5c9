import re
from collections import Counter, defaultdict

from graphlode.llm import divergence as dv

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=3, top=200):
    """rows: (text, lang, source); null counts as empty."""
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        own = Counter(TERM.findall(text.translate(LOWER)))
        counts[lang, source] += own
        holders[lang].update(own.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in holders[lang].items() if n >= min_docs}
        v = len(kept)
        p = {}
        for s in [*sources, None]:
            c = {t: counts[lang, s][t] if s is not None else sum(counts[lang, x][t] for x in sources) for t in kept}
            n = sum(c.values())
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def result(docs, **how):
    return sorted(map(tuple, dv.divergence(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


def with_sources(spark, rows):
    """Rows of the corpus dealt over sources, with extra columns of clashing names."""
    made = [(*r[:3], f"s{i % 4}" if i % 9 else None, *(["x"] * 5)) for i, r in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, term string, n string, p string, v string, total string"
    return spark.createDataFrame(made, names).repartition(3), [(r[1], r[2], r[3]) for r in made]


def test_equals_brute_force(spark, corpus):
    docs, rows = with_sources(spark, corpus)
    assert result(docs) == brute(rows)


def test_ties_at_the_end_of_a_short_report(spark):
    rows = [(" ".join(f"w{chr(97 + k)}" for k in range(10)), "en", s) for s in "aab"] + [("other words, É é", "en", "b")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(docs, top=4) == brute(rows, top=4)


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    rows = [(None, None, None), ("12 3!", "en", "a"), ("x", "en", "b"), ("one two", "de", "a"), ("one two", "de", "b"), ("", "fr", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(docs) == brute(rows)
    assert ("de", "a", "pair", "b", 0, 1) in result(docs)


def test_one_source_with_most_rows(spark):
    rows = [("the same text of one source", "en", "hot")] * 300 + [(f"text number{chr(97 + i % 26)} of another", "en", f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert result(docs) == brute(rows)


def test_small_tables_of_counts_and_long_texts(monkeypatch, spark, corpus):
    assert dv.terms_of("Ab ab É_ é".encode()) == {b"ab": 2, "É".encode(): 1, "é".encode(): 1}
    text = "Word WORD 日本語 " * 100
    plain = dv.terms_of(text.encode())
    monkeypatch.setattr(dv, "LONG", 50)
    assert dv.terms_of(text.encode()) == plain


def test_empty_table(no_docs):
    assert result(no_docs) == []
