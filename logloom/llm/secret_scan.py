"""Secret scan with multipart credential linking, on Spark functions only.

Base kinds are found by their patterns alone. The parts of a credential
(access identifiers, secrets, endpoints) are also sought in weaker forms that
mean little by themselves. An interval join on (document, bin of positions)
brings together the parts whose spans lie within ``SCOPE`` code points of each
other; a weak part is reported only if a complementary part is in its scope:

* a weak identifier or an endpoint needs a secret part,
* a weak secret needs an identifier or an endpoint.

Strong identifiers are the base kind access, strong secrets the base kinds
assign and hex. A weak part that overlaps a base span is left out.

Positions come from the lengths of the pieces between matches, summed over the
matches of a document; the long texts are never shuffled, only spans are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import text_of, write_once

SCOPE = 160
BIN = 256
MARK = "[SECRET]"

_EQUALS = r"""["']?\x20*[:=]\x20*["']?"""
# kind, role, strong, pattern, least length of group 1 (0: the whole match counts)
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _EQUALS + r"([A-Za-z0-9+/_.=-]+)"
KINDS = [
    ("assign", "secret", True, ASSIGN, 6),
    ("access", "identifier", True, r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", "secret", True, r"(?<![0-9a-f])[0-9a-f]{24,}", 0),
    ("identifier", "identifier", False,
     r"(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)" + _EQUALS + r"([A-Za-z0-9_.@+-]+)", 3),
    ("key_id", "identifier", False, r"(?<![A-Z0-9])(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}", 0),
    ("weak_secret", "secret", False,
     r"(?i:pwd|passphrase|pass|private_?key|auth|credentials?)" + _EQUALS + r"([A-Za-z0-9+/_.=-]+)", 4),
    ("opaque", "secret", False, r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40,}={0,2}", 0),
    ("endpoint", "endpoint", False,
     r"(?i:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s?ftp|ssh|jdbc:[a-z0-9]+)://[^\x00-\x20\x22\x27<>]+", 0),
    ("host", "endpoint", False, r"(?i:host(?:name)?|endpoint|server)" + _EQUALS + r"([A-Za-z0-9._:/-]+)", 4),
]
ORDER = {k[0]: i for i, k in enumerate(KINDS)}
BASE = [k[0] for k in KINDS[:3]]


def _matches(text: Column, kind: int, pattern: str, least: int) -> Column:
    """Per match: kind, place, code points before it since the last match, its
    length, and whether it holds enough characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    enough = (lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= least) if least else (lambda m: F.lit(True))
    rows = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
                       lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["g"].alias("gap"),
                                             F.length(x["m"]).alias("len"), enough(x["m"]).alias("ok")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(
        "array<struct<kind:int,at:int,gap:int,len:int,ok:boolean>>"))


def with_matches(docs: DataFrame, *keep: Column) -> DataFrame:
    """A written table: ``rid``, the ``keep`` columns and the matches of every
    kind in the whole text."""
    text = text_of()
    arrays = [_matches(text, i, k[3], k[4]) for i, k in enumerate(KINDS)]
    return write_once(docs.select(F.monotonically_increasing_id().alias("rid"), *keep,
                                  F.concat(*arrays).alias("found")), "matches")


def all_spans(matched: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of all base spans and the linked weak parts."""
    rows = matched.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    run = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = (rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(run))
             .withColumn("start", F.col("end") - F.col("len")).where("ok").select("rid", "kind", "start", "end"))
    spans = write_once(spans, "spans")
    roles = F.array(*[F.lit(k[1]) for k in KINDS])
    parts = spans.withColumn("role", F.get(roles, F.col("kind"))).withColumn("strong", F.col("kind") < len(BASE))
    # Interval join: a weak part covers the bins of its scope, any part its own.
    weak = parts.where("not strong").withColumn("bin", F.explode(F.expr(
        f"sequence(greatest(0, start - {SCOPE}) div {BIN}, (end + {SCOPE}) div {BIN})")))
    near = parts.withColumn("bin", F.explode(F.expr(f"sequence(start div {BIN}, (end - 1) div {BIN})"))).select(
        "rid", "bin", *[F.col(c).alias(f"o_{c}") for c in ("role", "strong", "start", "end")])
    overlap = F.expr("o_start < end and start < o_end and o_strong")
    complement = (F.when(F.col("role") == "secret", F.col("o_role") != "secret").otherwise(F.col("o_role") == "secret")
                  & F.expr(f"o_start < end + {SCOPE} and start - {SCOPE} < o_end and (o_start >= end or start >= o_end)"))
    linked = (weak.join(near, ["rid", "bin"]).groupBy("rid", "kind", "start", "end")
              .agg(F.max(overlap).alias("covered"), F.max(complement).alias("linked"))
              .where("linked and not covered").select("rid", "kind", "start", "end"))
    return spans.where(F.col("kind") < len(BASE)).unionByName(linked)


def _joined(rows: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (``kind:start:end`` by start, then kind; code points, end exclusive).

    A null text is empty; a document without spans has the digest of the empty
    string and an empty list. Rows that repeat a doc_id are documents of their
    own. An empty table gives an empty result; further columns are ignored."""
    matched = with_matches(docs, F.col("doc_id").cast("long").alias("doc_id"))
    by_doc = all_spans(matched).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    joined = matched.select("rid", "doc_id").join(by_doc, "rid", "left").withColumn(
        "s", F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    base = F.filter("s", lambda x: x["kind"] < len(BASE))
    counts = [F.size(F.expr(f"filter(s, x -> x.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return joined.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` replaced by ``mark`` and,
    where there is such a column, n_chars set to the new length. Every row
    stays; overlapping spans get one mark. Texts without a match are not
    shuffled."""
    matched = with_matches(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    run = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (all_spans(matched).select("rid", "start", "end").distinct()
            .withColumn("since", F.coalesce(F.max("end").over(run), F.lit(0).cast("long")))
            .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "since"))).alias("cuts"),
                                F.max("end").alias("last")))
    clean = matched.where(F.size("found") == 0)
    hit = matched.where(F.size("found") > 0).join(cuts, "rid", "left").withColumn("text", F.col("doc.text"))
    pieces = F.transform("cuts", lambda c: F.when(
        c["start"] >= c["since"],
        F.concat(F.substring(F.col("text"), c["since"].cast("int") + 1, (c["start"] - c["since"]).cast("int")), F.lit(mark)))
        .otherwise(F.lit("")))
    hit = hit.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join(pieces, ""), F.substring(F.col("text"), F.col("last").cast("int") + 1, F.length("text")))))
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.col("cuts").isNull(), F.col("doc.n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select("doc.*").unionByName(hit.select(doc.alias("doc")).select("doc.*"))
