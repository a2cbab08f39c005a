"""Secrets in texts, found by patterns, and weak parts of credentials that are reported only where complements stand near.

DataFrame functions only.  Strong kinds always count.  Weak kinds (account names, long opaque tokens, service addresses)
count only if a complementary part lies in their scope:

* an account name needs a secret,
* an opaque token needs an identifier or an address,
* an address needs an identifier and a secret,

at most ``scope`` code points away.  Each part asks for the nearest part of every role on either side, so the interval join is a
sweep over a document's parts in order: linear, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import settle
from larder.operators.settled import settled

# The kinds in their order, each with its pattern, the group that is measured and its least length.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # maximal runs: the same as [0-9a-f]+ with shorter matches dropped, without visiting them
}
WEAK = {
    "account": (r"""(?i:(user|username|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    "opaque": (r"[A-Za-z0-9+/]{32,}", 0, 32),
    "address": (r"""[a-z]{2,12}://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
KINDS = (*STRONG, *WEAK)
IDENTIFIERS, SECRETS, ADDRESSES = ("access", "account"), ("assign", "hex", "opaque"), ("address",)
SCOPE = 200
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _matches(pattern: str) -> Column:
    return F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a kind in ``_text``: lengths of the text between matches and of the matches add up to positions."""
    hits = F.col(f"_{kind}")
    measured = hits if group == 0 else F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(
        F.transform(F.slice(F.split("_text", pattern, -1), F.lit(1), F.size(hits)), F.length).alias("gap"),
        F.transform(hits, F.length).alias("size"),
        F.transform(measured, F.length).alias("measured"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def add(acc: Column, step: Column) -> Column:
        start = acc["at"] + step["gap"]
        end = start + step["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(step["measured"] >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.when(F.size(hits) > 0, F.aggregate(steps, empty, add)["found"]).otherwise(F.array().cast(_SPAN))


def _all_spans(df: DataFrame, kinds: dict) -> Column:
    return F.array_sort(F.concat(*[_spans(k, *kinds[k]) for k in kinds]))


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_strong`` and ``_weak`` spans, sorted, and ``_row``: a key for rows that have both roles to link."""
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = settled(df, {f"_{k}": _matches(p) for k, (p, _, _) in (STRONG | WEAK).items()})
    df = settled(df, {"_strong": _all_spans(df, STRONG), "_weak": _all_spans(df, WEAK)})
    linkable = (F.size("_weak") > 0) & (F.size("_strong") + F.size("_weak") > 1)
    row = F.when(linkable, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_text").cast("binary")))
    return df.withColumn("_row", row).drop("_text", *[f"_{k}" for k in KINDS])


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(_row, _linked): the weak spans of each row that have their complements in scope."""
    parts = found.where("_row IS NOT NULL").select("_row", F.explode(F.concat("_strong", "_weak")).alias("s")).select("_row", "s.*").distinct()
    order = Window.partitionBy("_row").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    strong = F.col("kind") < len(STRONG)
    covered = (F.max(F.when(strong, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"))
    parts = parts.withColumn("covered", F.coalesce(covered, F.lit(False)))
    # Sweep: each part passes its start, where it asks for the last end so far, and its end, where it asks for the next start.
    at_start, at_end = (F.struct(F.col(c).alias("at"), F.lit(c == "start").alias("begins")) for c in ("start", "end"))
    events = parts.withColumn("event", F.explode(F.array(at_start, at_end))).select("_row", "start", "kind", "end", "covered", "event.*")
    sweep = Window.partitionBy("_row").orderBy("at")
    so_far, still = sweep.rangeBetween(Window.unboundedPreceding, Window.currentRow), sweep.rangeBetween(Window.currentRow, Window.unboundedFollowing)

    def near(kinds: tuple[str, ...]) -> Column:
        mine = F.col("kind").isin([KINDS.index(k) for k in kinds])
        left = F.col("at") - F.max(F.when(mine & ~F.col("begins"), F.col("at"))).over(so_far)
        right = F.min(F.when(mine & F.col("begins"), F.col("at"))).over(still) - F.col("at")
        return F.coalesce(F.when(F.col("begins"), left).otherwise(right) <= scope, F.lit(False))

    seen = events.select("_row", "start", "kind", "end", "covered", near(IDENTIFIERS).alias("i"), near(SECRETS).alias("s"), near(ADDRESSES).alias("a"))
    marked = seen.groupBy("_row", "start", "kind", "end", "covered").agg(
        F.bool_or("i").alias("identifier"), F.bool_or("s").alias("secret"), F.bool_or("a").alias("address")
    )
    rule = (
        F.when(F.col("kind") == KINDS.index("account"), F.col("secret"))
        .when(F.col("kind") == KINDS.index("opaque"), F.col("identifier") | F.col("address"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    kept = marked.where(~strong & ~F.col("covered") & rule)
    return kept.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_linked"))


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("_strong", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs`` (doc_id, text; others are ignored).

    Positions count code points, ends are exclusive.  ``base_sha256`` digests the strong spans, ``spans`` lists all.  A null text
    counts as empty: no spans, the digest of the empty string.  Rows that repeat are each reported; a null doc_id stays null.
    """
    found = settle(_with_spans(docs.select("doc_id", "text")).select("doc_id", "_strong", F.when(F.col("_row").isNotNull(), F.col("_weak")).alias("_weak"), "_row"))
    none = found.where("_row IS NULL").withColumn("_linked", F.array().cast(_SPAN))
    some = found.where("_row IS NOT NULL").join(_linked(found, scope), "_row", "left")
    rows = none.select("doc_id", "_strong", "_linked").union(some.select("doc_id", "_strong", "_linked"))
    every = F.array_sort(F.concat("_strong", F.coalesce("_linked", F.array().cast(_SPAN))))
    return rows.select(
        "doc_id", *[_count(k) for k in STRONG], F.sha2(_text_of(F.col("_strong")).cast("binary"), 256).alias("base_sha256"), _text_of(every).alias("spans")
    )


def _masked(spans: Column) -> Column:
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("[REDACTED]"))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``[REDACTED]``; columns, rows and texts without secrets stay as they are."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"), "doc_id", "text")
    found = settle(_with_spans(packed))  # the patterns pass over every text once
    some = found.where("_row IS NOT NULL").join(_linked(found, scope), "_row", "left")
    none = found.where("_row IS NULL").withColumn("_linked", F.array().cast(_SPAN))
    rows = none.unionByName(some.select(none.columns))
    every = F.array_sort(F.concat("_strong", F.coalesce("_linked", F.array().cast(_SPAN))))
    rows = settled(rows, {"_every": every})
    masked = F.when(F.size("_every") > 0, _masked(F.col("_every"))).otherwise(F.col("text"))
    return rows.select(*[masked.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
