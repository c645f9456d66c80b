"""Personal data and the terms that give it away, in column expressions only.

Emails, IP addresses, card and phone numbers are found by pattern; each value is a
protected entity. A term discloses an entity as far as knowing the term makes the
entity likely. Over the corpus, with p as shares of documents, the information content
of an entity is IC(e) = -log2 p(e), and PMI(t, e) = log2(p(e | t) / p(e)), where t and e
occur together if t stands anywhere in a document of e, outside of all entities. A term
whose PMI reaches the share ``GENERALISE`` of the entity's IC is replaced by its kind of
word, one that reaches ``REMOVE`` is removed, at every place in the documents of e.

Copies of one text repeat its words beside its entities, so documents in which the same
``REACH`` characters stand around an entity are one context of it, and so are documents
that share passages of ``PASSAGE`` words, found by the least hashes of their passages
under ``SKETCH`` functions (nearly all that have a quarter in common) and chained. From ``CONTEXTS``
contexts on, p(e | t) is the share counted. Below, it is the lower end of that share's
confidence interval (Wilson's with continuity correction, one-sided 95%), copies of one
context counted once. No entity is too rare to be protected: two documents suffice for
an entity that is rarer than 1 in 1,070, one for an entity rarer than 1 in 490,000.

Splitting a text by a pattern and extracting its matches give the lengths of all gaps
and matches, hence all positions (code points, ends exclusive). No pattern starts again
inside a run that it has to cover whole, so long texts take time in proportion.

A null text is empty and has no spans. Repeated rows are documents of their own, and a
null id is kept. Extra columns are kept by ``rewrite`` and not read otherwise; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import free, let, uneven_join, whole, words_of
from tripgrid.llm.graph import components
from tripgrid.operators.lookup import lookup_join
from tripgrid.session import stage

#: Base kinds in the order of reports, then those of the method.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
REACH = 64
CONTEXTS = 5
GENERALISE = 0.8
REMOVE = 0.95
# Quantile of the confidence bound for fewer than CONTEXTS contexts.
Z = 1.645
PASSAGE = 8
SKETCH = 16
# Matches whose places are summed one after the other.
BLOCK = 512
TERM = r"\p{L}{3,}"

# An email starts where a run of its characters starts, or where the last match ended inside one.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the last but one doubled, less 9 if over 9; the sum ends in 0."""

    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    terms = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), term)
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _octets(value: Column) -> Column:
    small = lambda part: let(F.regexp_replace(part, "^0+(?=[0-9])", ""), lambda p: (F.length(p) < 4) & (F.substring(p, 1, 3).cast("int") <= 255))
    return F.forall(F.split(value, r"\."), small)


def _card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))


#: Kind, pattern, what a match must pass, what a text with a match must contain, and the entity it names.
PATTERNS: tuple[tuple[str, str, Callable[[Column], Column], str, Callable[[Column], Column]], ...] = (
    ("email", EMAIL, lambda v: F.lit(True), "@", F.lower),
    ("ip", IP, _octets, r"[0-9]\.[0-9]", lambda v: v),
    ("card", CARD, _card, r"[0-9](?:[\x20-]?[0-9]){11}", _digits),
    ("phone", PHONE, lambda v: F.length(_digits(v)).between(9, 15), r"\+[0-9]", _digits),
)


def _running(x: Column) -> Column:
    """Running sums of a short array."""

    def step(acc: Column, v: Column) -> Column:
        total = acc["at"] + F.coalesce(v, F.lit(0))
        return F.struct(total.alias("at"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def _running_long(x: Column) -> Column:
    """Running sums of an array of any length: inside blocks first, so that none grows by copying far."""

    def joined(parts: Column) -> Column:
        before = _running(F.transform(parts, lambda r: F.get(r, F.size(r) - 1)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda r, i: F.transform(r, lambda v: v + F.coalesce(F.get(b, i - 1), F.lit(0))))))

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(starts, lambda at: _running(F.slice(a, at, BLOCK))), joined)

    return let(x, lambda a: F.when(F.size(a) <= BLOCK, _running(a)).otherwise(blocks(a)))


def _matches(text: Column, pattern: str, reach: int = 0, running: Callable[[Column], Column] = _running_long) -> Column:
    """(start, end, m, left, right) of every match; left and right are up to ``reach`` characters beside it."""

    def place(p: Column) -> Column:
        found, gaps = p["found"], p["gaps"]
        ends = running(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i))))

        def item(end: Column, i: Column) -> Column:
            m = F.get(found, i)
            # One character more tells whether a word is cut off.
            left = F.right(F.get(gaps, i), F.lit(reach + 1)) if reach else F.lit("")
            right = F.left(F.get(gaps, i + 1), F.lit(reach + 1)) if reach else F.lit("")
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), left.alias("left"), right.alias("right"))

        return let(ends, lambda e: F.transform(e, item))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern).alias("gaps")), place)


ENTITY = "struct<start:int,rank:int,end:int,entity:string,context:bigint>"


def entities(text: Column, reach: int = REACH) -> Column:
    """All entities of a text by start, then kind, each with a hash of what stands around it."""
    nothing = F.array().cast(f"array<{ENTITY}>")

    def of_kind(rank: int, kind: str, pattern: str, passes, needs: str, name) -> Column:
        def item(x: Column) -> Column:
            return F.struct(
                x["start"].alias("start"),
                F.lit(rank).alias("rank"),
                x["end"].alias("end"),
                F.concat(F.lit(kind + ":"), name(x["m"])).alias("entity"),
                F.xxhash64(x["left"], x["right"]).alias("context"),
            )

        found = F.filter(_matches(text, pattern, reach), lambda x: passes(x["m"]))
        return F.when(text.rlike(needs), F.transform(found, item).cast(f"array<{ENTITY}>")).otherwise(nothing)

    return F.array_sort(F.concat(*[of_kind(rank, *p) for rank, p in enumerate(PATTERNS)]))


def _blanked(text: Column, found: Column) -> Column:
    """``text`` with spaces in place of its entities, so that all other places stay."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fill = F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], acc["at"]), F.lit(0)))
        return F.struct(F.concat(acc["done"], gap, fill).alias("done"), F.greatest(acc["at"], x["end"]).alias("at"))

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    return F.aggregate(found, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(row, doc_id, found, rest): the entities of every text, and what else a text with entities holds."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), whole(text).alias("text"))
    held = own.withColumn("found", entities(F.col("text"), reach))
    return held.select("row", "doc_id", "found", F.when(F.size("found") > 0, _blanked(F.col("text"), F.col("found"))).alias("rest"))


def _document_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))


def _rest_terms(rest: Column) -> Column:
    lowered = F.transform(F.regexp_extract_all(rest, F.lit(TERM), 0), F.lower)
    return F.array_distinct(F.filter(lowered, lambda t: t.rlike(r"^\p{L}+$")))


def _sketch(rest: Column) -> Column:
    """The least hash of the passages of a text under each function."""

    def passages(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - PASSAGE + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, PASSAGE)))

    functions = F.array(*[F.lit(j) for j in range(SKETCH)])
    return let(let(words_of(rest), passages), lambda h: F.transform(functions, lambda j: F.array_min(F.transform(h, lambda x: F.xxhash64(x, j)))))


def copies(told: DataFrame) -> DataFrame:
    """(row, copy) of texts (row, rest); texts that share passages have one value of copy."""
    each = told.select("row", F.posexplode(_sketch(F.col("rest"))).alias("j", "m"))
    # Rows are not negative, hashes as nodes are.
    roots = components(each.select(F.col("row").alias("a"), F.xxhash64("j", "m").bitwiseOR(F.lit(-(2**63))).alias("b")))
    return roots.filter("node >= 0").select(F.col("node").alias("row"), F.col("root").alias("copy"))


def _least(k: Column, n: Column) -> Column:
    """Lower confidence bound of a share of which ``k`` of ``n`` were seen."""
    spread = F.sqrt(Z * Z - 1 / n + 4 * k * (1 - k / n) + 4 * k / n - 2)
    return (2 * k + Z * Z - (Z * spread + 1)) / (2 * (n + Z * Z))


def _least_of_all(k: int) -> float:
    """The bound if all of ``k`` were seen."""
    return (2 * k + Z * Z - (Z * math.sqrt(Z * Z - 1 / k + 2) + 1)) / (2 * (k + Z * Z))


def together(docs: DataFrame, found: DataFrame, total: float, text: str = "text", contexts: int = CONTEXTS, generalise: float = GENERALISE) -> DataFrame:
    """(row, entity, context, with_e, copy, term, with_t) of every term in a document of every entity.

    Left out are only pairs that no count lets reach ``generalise``: as e has at least the
    documents of both, p(e | t) is at most with_e / with_t, and the bound for k contexts is
    at most that for k of k. Counts are combined before they are shuffled.
    """
    each = found.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.entity", "f.context")
    by_row = each.groupBy("row", "entity").agg(F.min("context").alias("context"))
    by_context = by_row.groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n"))
    known = by_context.groupBy("entity").agg(F.sum("n").alias("with_e"), F.count(F.lit(1)).alias("k"))
    content = F.log2(F.lit(total) / F.col("with_e"))
    enough = F.col("k") >= contexts
    fewest = contexts
    for k in range(contexts - 1, 0, -1):
        enough = enough | ((F.col("k") == k) & (content * (1 - generalise) >= -math.log2(_least_of_all(k))))
        if math.log2(total) * (1 - generalise) >= -math.log2(_least_of_all(k)):
            fewest = k
    # The least share counted that makes t tell enough of e allows this many documents of t.
    most = (F.pow(F.lit(total), F.lit(1 - generalise)) * F.pow("with_e", F.lit(generalise)) * (1 + 1e-9)).alias("most")
    known = stage(known.filter(enough & (content > 0)).select("entity", "with_e", most), "entities")
    top = known.df.agg(F.max("most")).first()[0] or 0.0
    holding = stage(lookup_join(by_row, known, ["entity"]), "holding").df
    spoken = docs.select(F.explode(_document_terms(whole(text))).alias("term"))
    with_t = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("with_t")).filter(F.col("with_t").between(fewest, top))
    told = stage(found.select("row", "rest").join(holding.select("row").distinct(), "row", "left_semi"), "told").df
    holding = holding.join(copies(told), "row")
    terms = told.select("row", F.explode(_rest_terms(F.col("rest"))).alias("term"))
    terms = uneven_join(terms, stage(with_t, "terms").df, "term").filter(F.col("with_t").isNotNull())
    return holding.join(terms, "row").filter(F.col("with_t") <= F.col("most")).drop("most")


def disclosures(pairs: DataFrame, total: float, contexts: int = CONTEXTS, generalise: float = GENERALISE) -> DataFrame:
    """(term, entity, disclosure) of pairs whose PMI is at least the share ``generalise`` of the entity's IC."""
    values = [F.first(c).alias(c) for c in ("with_e", "with_t")]
    k = F.least(F.count_distinct("context"), F.count_distinct("copy"))
    counted = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), k.alias("k"), *values)
    both, k = F.col("both"), F.col("k")
    likely = F.when(k >= contexts, both / F.col("with_t")).otherwise(_least(k, F.greatest(F.col("with_t") - both, F.lit(0)) + k))
    share = F.log2(likely * total / F.col("with_e")) / F.log2(F.lit(total) / F.col("with_e"))
    return counted.select("term", "entity", share.alias("disclosure")).filter(F.col("disclosure") >= generalise)


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    contexts: int = CONTEXTS,
    generalise: float = GENERALISE,
    remove_at: float = REMOVE,
    reach: int = REACH,
) -> DataFrame:
    """(row, doc_id, spans) for each row of ``docs``; spans are (kind, start, end) by start, then kind."""
    held = stage(find(docs, id, text, reach), "entities")
    total, held = float(max(held.rows, 1)), held.df
    pairs = stage(together(docs, held, total, text, contexts, generalise), "pairs").df
    risky = stage(disclosures(pairs, total, contexts, generalise), "disclosures")
    hits = lookup_join(pairs.select("row", "entity", "term"), risky, ["entity", "term"])
    worst = hits.groupBy("row", "term").agg(F.max("disclosure").alias("d"))
    told = worst.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("told"))
    marked = F.transform(
        _matches(F.col("rest"), TERM),
        lambda t: F.struct(t["start"].alias("start"), F.try_element_at("told", F.lower(t["m"])).alias("d"), t["end"].alias("end")),
    )
    rank = lambda d: F.when(d >= remove_at, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    added = F.transform(F.filter(marked, lambda t: t["d"].isNotNull()), lambda t: F.struct(t["start"], rank(t["d"]).alias("rank"), t["end"]))
    base = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    more = F.when(F.col("told").isNotNull(), added).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.array_sort(F.concat(base, more)),
        lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return held.join(told, "row", "left").select("row", "doc_id", spans.alias("spans"))


def printed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")


def rewritten(text: Column, spans: Column) -> Column:
    """``text`` with entities and generalised terms replaced by their kind, and removed terms left out.

    Spans that overlap an earlier one are covered by its replacement.
    """

    def stands_for(p: Column) -> Column:
        word = F.substring(text, p["start"] + 1, F.lit(1))
        general = F.when(F.upper(word) == word, "[NAME]").otherwise("[WORD]")
        return F.when(p["kind"] == "remove", "").when(p["kind"] == "generalise", general).otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")))

    def step(acc: Column, p: Column) -> Column:
        fresh = p["start"] >= acc["at"]
        added = F.concat(acc["done"], F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), stands_for(p))
        return F.struct(F.when(fresh, added).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], p["end"]).alias("at"))

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))


def rewrite(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with sanitised texts. Rows are numbered when they are written, to meet their spans again."""
    row = free("__row", docs.columns)
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "docs").df
    found = scan(held, row, text, **options).select(F.col("doc_id").alias(row), F.col("spans").alias(spans := free("__spans", held.columns)))
    clean = F.when(F.size(spans) > 0, rewritten(F.col(text), F.col(spans))).otherwise(F.col(text))
    return held.join(found, row).withColumn(text, clean).select(*docs.columns)
