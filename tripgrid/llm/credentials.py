"""Secret scans with multipart credential linking.

Parts of credentials have a role: an access identifier, a secret or an endpoint. Strong
parts (assigned secrets, access key ids, long hexadecimal runs) are reported on their
own. Weak ones (bare mixed-character keys, user or client names, urls and host settings)
are everyday text, so each is reported only if a complementary part lies within its
scope, ``SCOPE`` characters around it in the same text: a secret beside an identifier or
an endpoint, and an identifier or an endpoint beside a secret, weak ones too. A key
inside a url is not beside it. Parts meet in an interval join on scope-wide buckets of
position; parts of one kind do not overlap, so a bucket holds a bounded number of them
however long its text is.

Positions are code points, ends exclusive. A null text is empty and has no parts.
Repeated rows are judged as often as they occur, rows with a null id too; extra columns
are kept by ``redact`` and not read by ``scan``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import free, whole
from tripgrid.session import stage

#: Kinds in the order of reports, with role and strength.
KINDS = {
    "assign": ("secret", True),
    "access": ("id", True),
    "hex": ("secret", True),
    "key": ("secret", False),
    "name": ("id", False),
    "endpoint": ("endpoint", False),
}
SCOPE = 256
PLACEHOLDER = "[SECRET]"

_FLAGS = re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", _FLAGS)
# Runs that a base rule would drop for their length are not visited.
HEX = re.compile(r"[0-9a-f]{24,}", _FLAGS)
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}", _FLAGS)
NAME = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", _FLAGS | re.IGNORECASE)
ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?)""", _FLAGS | re.IGNORECASE)
_ORDER = {k: i for i, k in enumerate(KINDS)}

SPAN = "struct<kind:string,start:int,end:int>"


def _mixed(key: str) -> bool:
    return any(c.isupper() for c in key) and any(c.islower() for c in key) and any(c.isdigit() for c in key)


def parts(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every part of a text, by start, then kind; weak ones only outside strong ones."""
    strong = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        strong += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    strong += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    weak = [("key", m.start(), m.end()) for m in KEY.finditer(text) if _mixed(m[0])]
    if "=" in text or ":" in text:
        weak += [("name", m.start(), m.end()) for m in NAME.finditer(text)]
        weak += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if strong and weak:
        # Reach of the strong parts that start up to each of them: a weak one is clear if that ends before it.
        strong.sort(key=lambda p: p[1])
        starts, reach = [p[1] for p in strong], list(accumulate((p[2] for p in strong), max))
        weak = [w for w in weak if not (k := bisect_left(starts, w[2])) or reach[k - 1] <= w[1]]
    return sorted(strong + weak, key=lambda p: (p[1], _ORDER[p[0]]))


def _is(kind: Column, role: str | None = None, strong: bool | None = None) -> Column:
    return kind.isin([k for k, (r, s) in KINDS.items() if role in (None, r) and strong in (None, s)])


def find_parts(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all, if None) and the parts of every text, whose column name is returned too."""
    keep = list(docs.columns if keep is None else keep)
    out, body = free("__parts", docs.columns), free("__body", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        names = ("kind", "start", "end")
        for batch in batches:
            found = [[dict(zip(names, p, strict=True)) for p in parts(t.as_py())] for t in batch.column(body)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, kind)], [*keep, out])

    schema = docs.select(*keep).withColumn(out, F.lit(None).cast(f"array<{SPAN}>")).schema
    return docs.select(*keep, whole(text).alias(body)).mapInArrow(run, schema), out


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Complementary parts of rows (row, kind, start, end) that lie within ``scope`` of each other.

    One row (row, weak, other) for each weak part and each part that supports it.
    """
    weak, other = F.struct("kind", "start", "end").alias("weak"), F.struct("kind", "start", "end").alias("other")
    bucket = (F.col("start") / scope).cast("int")
    # A part that starts within the scope of a weak one starts in its bucket or beside it;
    # long ones reach back, so they are entered in each bucket they touch.
    left = found.filter(_is(F.col("kind"), strong=False)).select("row", weak, F.explode(F.sequence(bucket - 1, (F.col("end") / scope).cast("int") + 1)).alias("bucket"))
    right = found.select("row", other, F.explode(F.sequence(bucket, (F.col("end") / scope).cast("int"))).alias("bucket"))
    w, o = F.col("weak.kind"), F.col("other.kind")
    apart = (F.col("weak.end") <= F.col("other.start")) | (F.col("other.end") <= F.col("weak.start"))
    beside = (_is(w, "secret") & _is(o, "endpoint")) | (_is(w, "endpoint") & _is(o, "secret"))
    complementary = (_is(w, "secret") & _is(o, "id")) | (_is(w, "id") & _is(o, "secret")) | (beside & apart)
    near = (F.col("other.start") - F.col("weak.end") <= scope) & (F.col("weak.start") - F.col("other.end") <= scope)
    return left.join(right, ["row", "bucket"]).filter(complementary & near).select("row", "weak", "other").distinct()


def _confirmed(held: DataFrame, row: str, found: str, scope: int) -> DataFrame:
    """(row, spans): the supported weak parts of the rows that have weak parts."""
    exploded = held.filter(F.exists(found, lambda p: _is(p["kind"], strong=False))).select(F.col(row).alias("row"), F.explode(found).alias("p"))
    links = link(exploded.select("row", "p.*"), scope)
    return links.select("row", "weak").distinct().groupBy("row").agg(F.collect_list("weak").alias("spans"))


def _spans(found: Column, confirmed: Column) -> Column:
    """Strong parts and confirmed weak ones by start, then kind."""
    rank = F.create_map(*[x for k, i in _ORDER.items() for x in (F.lit(k), F.lit(i))])
    strong = F.filter(found, lambda p: _is(p["kind"], strong=True))
    both = F.concat(strong, F.coalesce(confirmed, F.array().cast(f"array<{SPAN}>")))
    ranked = F.array_sort(F.transform(both, lambda p: F.struct(p["start"].alias("start"), rank[p["kind"]].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"))))
    return F.transform(ranked, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row (doc_id, spans) for each row of ``docs``; spans are by start, then kind."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).alias("text"))
    parsed, found = find_parts(own, "text", ("row", "doc_id"))
    held = stage(parsed, "parts").df
    weak = _confirmed(held, "row", found, scope)
    return held.join(weak, "row", "left").select("doc_id", _spans(F.col(found), F.col("spans")).alias("spans"))


def printed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with a placeholder for each stretch that spans cover; spans that overlap share one."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        fresh = p["start"] >= acc["at"]
        added = F.concat(acc["done"], F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), F.lit(PLACEHOLDER))
        return F.struct(F.when(fresh, added).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], p["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced, and ``length`` (if there is such a column) counted anew.

    Texts are written once with their parts. Only rows with weak parts are shuffled, to
    meet the parts that were confirmed; all others are rewritten where they are.
    """
    row = free("__row", docs.columns)
    parsed, found = find_parts(docs.withColumn(row, F.monotonically_increasing_id()), text)
    held = stage(parsed, "parts").df
    weak = _confirmed(held, row, found, scope).withColumnRenamed("row", row)
    unsure = F.exists(found, lambda p: _is(p["kind"], strong=False))
    spans = free("__spans", held.columns)
    plain = held.filter(~unsure).withColumn(spans, F.lit(None).cast(f"array<{SPAN}>"))
    joined = held.filter(unsure).join(weak.withColumnRenamed("spans", spans), row, "left")
    both = plain.unionByName(joined).withColumn(spans, _spans(F.col(found), F.col(spans)))
    changed = F.size(spans) > 0
    out = both.withColumn(text, F.when(changed, _replaced(F.col(text), F.col(spans))).otherwise(F.col(text)))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(changed, F.length(text).cast(kind)).otherwise(F.col(length)))
    return out.select(*docs.columns)
