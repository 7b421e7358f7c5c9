"""Personal data in texts: fixed forms, and identifiers found through the words around them. DataFrame functions only.

Forms. E-mail addresses, IPv4 addresses, card numbers and telephone numbers have patterns of their own, whose matches are checked
(parts, digits, check sum). A text is split at a pattern and its matches are taken out; the lengths of both give places in code points. The
patterns run once over a text, whatever it holds: no group of a pattern repeats, and what begins inside a run that was already tried is not
tried again. Marks that may stand between two digits or labels only are set apart beforehand, character by character.

Contexts. The matches are seed entities. The one and two words before each are its lexical patterns. Looser forms (an address without a domain's end,
digits in groups, hexadecimal parts) that lie beside all matches are unseen candidates of their kind. Patterns and instances form a bipartite graph whose edges count documents. In
each round a pattern scores W / (W + other + U / 4): W documents in which an instance follows it, weighted by what is known of the instance (a seed: 1), U those with an unknown candidate,
and `other` the remaining documents that hold its words, counted over the whole corpus. Patterns of at least `min_support` known instances and a score of
`accept` pass their score on to their candidates; the rounds end when none is new. So "e-mail address: " finds what follows it, and "of the" nothing.

Defined results: a null text is empty; a null id stays null; rows that repeat id and text have equal results; contexts are compared without case (A-Z) and marks but : = # , and
at most 64 characters far; texts without digits and @ have no spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Before a pattern runs, what cannot be part of a match is replaced by a character of the same length that never is.
_APART = {
    "email": (rf"\.(?![{_LABEL}])|(?<![{_LABEL}])\.", "_"),  # dots that are between no two labels
    "card": (r"(?<=[0-9])[\x20-](?![0-9])|(?<![0-9])[\x20-](?=[0-9])", "\n"),  # spaces and dashes with a digit on one side
}
#: The forms; what precedes a match is either no part of the run that it starts in, or the end of the match before.
_FORM = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x20-])[0-9][0-9\x20-]{11,35}[0-9](?![0-9\x20-])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of this have no match of the form.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{11}", "phone": r"\+[0-9]"}
#: Looser forms, of bounded length.
_LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:@|\x20?[(\[][aA][tT][)\]]\x20?)[{_LABEL}]{{1,63}}(?:(?:\.|\x20?[(\[][dD][oO][tT][)\]]\x20?)[{_LABEL}]{{1,63}}){{0,4}}(?![{_LABEL}])",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?:[:.]{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9][0-9\x20-]{10,35}[0-9](?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])[+(]{0,2}[0-9][0-9\x20().-]{5,24}[0-9](?![0-9A-Za-z])",
}
_LOOSE_HINT = {"email": r"@|[(\[][aA][tT][)\]]", "ip": r"[0-9A-Fa-f][:.]{1,2}[0-9A-Fa-f]", "card": r"[0-9][0-9\x20-]{10}", "phone": r"[0-9][0-9\x20().-]{5}"}
_SPAN = "array<struct<start:long,stop:long,s:string,left:string>>"
#: Characters of context that are looked at; spans whose places are added up together.
NEAR, CHUNK = 64, 256
#: All scores are thousandths.
KNOWN = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """start, stop (code points), s (the match) and left (what is before it, after the last match) of all matches."""
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def lengths(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, i: (F.length(m) + F.length(F.get(x["gaps"], i))).cast("long"))
        return F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), sizes.alias("sizes"))

    def total(sizes: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(sizes, first + 1, n), F.lit(0).cast("long"), lambda a, s: a + s)

    def sums(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), (F.size(x["found"]) / F.lit(CHUNK)).cast("int")), lambda b: total(x["sizes"], b * CHUNK, F.lit(CHUNK)))
        return F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), x["sizes"].alias("sizes"), chunks.alias("chunks"))

    def offsets(x: Column) -> Column:
        before = F.transform(x["chunks"], lambda _, b: total(x["chunks"], F.lit(0), b))
        return F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), x["sizes"].alias("sizes"), before.alias("before"))

    def places(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap, chunk = F.get(x["gaps"], i), (i / F.lit(CHUNK)).cast("int")
            start = F.get(x["before"], chunk) + total(x["sizes"], chunk * CHUNK, i % CHUNK) + F.length(gap)
            return let(start, lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("s"), F.right(gap, F.lit(NEAR)).alias("left")))

        return F.transform(x["found"], one)

    return let(let(let(let(cut, lengths), sums), offsets), places)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)

    def value(k: Column) -> Column:  # k: from the right, from 1
        d = F.substr(number, n - k + 1, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    match kind:
        case "email":
            return F.lit(True)
        case "ip":
            return F.forall(F.split(s, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255"))))
        case "card":
            return let(digits(s), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
        case _:
            return F.length(digits(s)).between(9, 15)


def _plausible(kind: str, s: Column) -> Column:
    """What a candidate of a kind has at least."""
    match kind:
        case "email":
            return F.lit(True)
        case "ip":
            return s.rlike("[0-9]")
        case "card":
            return F.length(digits(s)).between(12, 19)
        case _:
            return F.length(digits(s)).between(7, 15)


def _spans(kind: str, text: Column, loose: bool) -> Column:
    apart, form, hint = _APART.get(kind) if not loose else None, (_LOOSE if loose else _FORM)[kind], (_LOOSE_HINT if loose else _HINT)[kind]
    set_apart = F.regexp_replace(text, *apart) if apart else text
    check = _plausible if loose else _valid
    return F.when(text.rlike(hint), F.filter(matches(set_apart, form), lambda x: check(kind, x["s"]))).otherwise(F.array().cast(_SPAN))


def words(text: Column) -> Column:
    """The words that contexts are made of: without A-Z in capitals and without marks but : = #."""
    plain = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^\p{L}\p{N}:=#\x20\x09-\x0D]", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _keys(w: Column) -> Column:
    """Keys of the contexts in a list of words: each word, and each two in a row."""
    one = F.transform(w, lambda x: F.xxhash64(x))
    two = F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.xxhash64(F.get(w, i), x))
    return F.array_distinct(F.concat(one, two))


def _last_keys(left: Column) -> Column:
    """Keys of the last word and the last two words."""
    return let(words(left), lambda w: let(F.size(w), lambda n: F.filter(F.array(F.when(n > 0, F.xxhash64(F.get(w, n - 1))), F.when(n > 1, F.xxhash64(F.get(w, n - 2), F.get(w, n - 1)))), lambda k: k.isNotNull())))


def candidates(found: DataFrame) -> DataFrame:
    """key, kind, start, stop, inst, left, seed: the matches of found (key, base, loose), and the looser ones that lie beside all matches of the text."""
    flat = found.select("key", F.explode("spans").alias("x")).select("key", "x.*").distinct()
    forward, back = (Window.partitionBy("key").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("start", F.desc("seed")), (F.desc("start"), "seed")))
    before = F.max(F.when(F.col("seed"), F.col("stop"))).over(forward)
    after = F.min(F.when(F.col("seed"), F.col("start"))).over(back)
    beside = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("stop")) >= F.col("stop"))
    placed = flat.withColumn("before", before).withColumn("after", after)
    return placed.where(F.col("seed") | beside).drop("before", "after")


def bootstrap(edges: DataFrame, totals: DataFrame, min_support: int, accept: int, rounds: int) -> DataFrame:
    """kind, inst, score of the unseen instances that patterns vouch for.

    edges: kind, pattern, inst, seed, docs; totals: pattern, total (documents that hold its words).
    """
    patterns = edges.groupBy("kind", "pattern").agg(F.sum("docs").alias("all_docs")).join(totals, "pattern")
    other = staged(patterns.select("kind", "pattern", F.greatest(F.col("total") - F.col("all_docs"), F.lit(0)).alias("other")), "pii-patterns")
    edges = staged(edges.join(other.select("kind", "pattern"), ["kind", "pattern"], "left_semi"), "pii-edges")
    known, have = staged(edges.limit(0).select("kind", "inst", F.lit(0).cast("long").alias("score")), "pii-known"), 0
    for _ in range(rounds):
        weighed = edges.join(known, ["kind", "inst"], "left").withColumn("w", F.when(F.col("seed"), F.lit(KNOWN)).otherwise(F.coalesce("score", F.lit(0))).cast("long"))
        sums = weighed.groupBy("kind", "pattern").agg(
            F.sum(F.col("docs") * F.col("w")).alias("w"), F.sum(F.when(F.col("w") == 0, F.col("docs")).otherwise(0)).alias("u"), F.count_if(F.col("w") >= accept).alias("support")
        )
        score = F.expr(f"(w * {4 * KNOWN}) div (4 * w + {KNOWN} * (4 * other + u))")
        good = sums.where(F.col("support") >= min_support).join(other, ["kind", "pattern"]).withColumn("score", score).where(F.col("score") >= accept)
        known = staged(edges.where("not seed").join(good.select("kind", "pattern", "score"), ["kind", "pattern"]).groupBy("kind", "inst").agg(F.max("score").alias("score")), "pii-known")
        before, have = have, known.count()
        if have == before:
            break
    return known


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, accept: int = 700, rounds: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base (array of kind, start, stop), spans (base and discovered)."""
    rows = documents(docs, id_col, text_col)
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)
    kinds = rows.select("doc_id", "text", *(_spans(k, F.col("text"), False).alias(k) for k in KINDS), *(_spans(k, F.col("text"), True).alias(f"loose_{k}") for k in KINDS))

    def tagged(name: str, kind: str, seed: bool) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lower(x["s"]).alias("inst"), x["left"].alias("left"), F.lit(seed).alias("seed")))

    spans = F.concat(*(tagged(k, k, True) for k in KINDS), *(tagged(f"loose_{k}", k, False) for k in KINDS))
    found = staged(kinds.select("doc_id", key.alias("key"), spans.alias("spans"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS)), "pii-forms")
    near = candidates(found.where(F.size("spans") > 0))
    near = staged(near.select("key", "kind", "start", "stop", "inst", "seed", _last_keys(F.col("left")).alias("patterns")), "pii-candidates")

    # patterns of too few instances of their kind are out before anybody counts their words
    edges = near.select("key", "kind", "inst", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "inst", "seed").agg(F.count_distinct("key").alias("docs"))
    edges = staged(edges, "pii-contexts")
    held = edges.groupBy("kind", "pattern").agg(F.count_distinct("inst").alias("n"), F.min(F.col("seed").cast("int")).alias("all_seeds"))
    held = staged(held.where(F.col("n") > min_support).where("all_seeds = 0").select("kind", "pattern"), "pii-supported")
    wanted = held.select("pattern").distinct()
    totals = rows.select(F.explode(let(words(F.col("text")), _keys)).alias("pattern")).join(wanted, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    if held.isEmpty():
        new = near.limit(0).select("key", "kind", "start", "stop")
    else:
        supported = edges.join(held, ["kind", "pattern"], "left_semi")
        new = near.where("not seed").join(bootstrap(supported, totals, min_support, accept, rounds), ["kind", "inst"]).select("key", "kind", "start", "stop").distinct()
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    added = new.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    out = found.join(added, "key", "left").withColumn("base", F.transform(F.filter("spans", lambda x: x["seed"]), place))
    number = F.create_map(*(v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))))
    in_order = F.array_sort(F.transform(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))), lambda x: F.struct(number[x["kind"]].alias("n"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.transform(in_order, place).alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:stop of all spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])))
