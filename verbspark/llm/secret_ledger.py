"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a blob, named by the SHA-256 of its content.
The ledger records, for each pair of a blob and a rule version, the spans that
were found; a pair that is in it is never scanned again.  A scan hashes all
versions, keeps the pairs that the ledger lacks, reads each such blob from one
of its places, appends the findings to the ledger, and joins them back to all
paths that have the blob.

Texts are shuffled only if neither the blobs that need a scan nor the places
that need none are few enough to be sent to all executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpointed, exists

#: Up to so many blob names are sent to all executors (about 600 bytes each); more are joined by a shuffle.
BROADCAST_BLOBS = 50_000
#: Up to so many blobs with findings are sent to all executors; more are joined by a shuffle.
BROADCAST_FINDINGS = 50_000


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern, leftmost and not overlapping, of which those that fail `accept` are dropped."""

    kind: str
    pattern: str
    version: int = 1
    base: bool = False
    accept: Callable[[re.Match], bool] | None = None
    needs: tuple[str, ...] = ()  # a text without any of these, whatever the case, has no match


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 20


#: The base kinds and what they match.
BASE_RULES = (
    Rule("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", base=True, accept=_long_value, needs=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", base=True, accept=_long_key),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: Published formats of other secrets.
MORE_RULES = (
    # To the END line if no other such line comes before it, otherwise over header lines and key lines.
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----|(?:[ \t\r]*\n[A-Za-z][A-Za-z0-9-]*:[^\n]*)*[A-Za-z0-9+/=\x09-\x0D\x20]*)", version=3),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_password", r"://[^\x00-\x20/:@]*:[^\x00-\x20/@]{6,}@", version=3),
)
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<kind: string, start: long, end: long>>"
_RULE = "struct<kind: string, version: int>"
#: Blob names that a task remembers, so as to scan copies within it once.
_REMEMBERED = 200_000


def find_spans(rules: tuple[Rule, ...], text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches, in code points, by start and then in the rules' order."""
    out = []
    folded = text.lower()
    for order, rule in enumerate(rules):
        if rule.needs and not any(word in folded for word in rule.needs):
            continue
        for m in re.finditer(rule.pattern, text):
            if rule.accept is None or rule.accept(m):
                out.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scanner(rules: tuple[Rule, ...]):
    """(body, blob, todo) becomes (blob, rule, spans), a row per rule; copies within a task are read once."""
    spans_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rule_kind = pa.struct([("kind", pa.string()), ("version", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                rows = []
                for text, blob, todo in zip(*(b.column(i).slice(at, 128).to_pylist() for i in range(3))):
                    if blob in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(blob)
                    wanted = {(t["kind"], t["version"]) for t in todo}
                    chosen = tuple(r for r in rules if (r.kind, r.version) in wanted)
                    spans = find_spans(chosen, text)
                    rows += [(blob, {"kind": r.kind, "version": r.version}, [{"kind": k, "start": s, "end": e} for k, s, e in spans if k == r.kind]) for r in chosen]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), rule_kind, spans_kind))], names=["blob", "rule", "spans"])

    return run


class Scan(NamedTuple):
    """findings: a row per version with its blob and spans; entries: what the ledger lacked, (blob, rule, spans)."""

    findings: DataFrame
    entries: DataFrame


def _every(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules)).cast(f"array<{_RULE}>")


def _texts(versions: DataFrame, id_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """(place, body, blob): all versions, a null text as the empty one."""
    place = F.struct(*(F.col(c).alias(f"id{i}") for i, c in enumerate(id_cols))).alias("place")
    return versions.select(place, F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("blob", F.sha2("body", 256))


def _known(ledger: DataFrame) -> DataFrame:
    return ledger.select("blob", F.col("rule").cast(_RULE).alias("rule"), F.col("spans").cast(_SPANS).alias("spans"))


def _unseen(texts: DataFrame, places: DataFrame, known: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Scans the blobs of `texts` by the rules that `known` lacks for them, each at its first place: (blob, rule, spans)."""
    every = _every(rules)
    blobs = places.groupBy("blob").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    if known is None:
        blobs = blobs.withColumn("todo", every)
    else:
        have = known.groupBy("blob").agg(F.collect_set("rule").alias("have"))
        lacking = F.array_except(every, F.coalesce("have", F.array().cast(f"array<{_RULE}>")))
        blobs = blobs.join(have, "blob", "left").select("blob", "first", "n", lacking.alias("todo"))
    blobs = checkpointed(blobs)
    plain = (F.col("n") == 1) & (F.size("todo") == len(rules))  # one place, and all rules
    sizes = blobs.agg(F.count_if(F.size("todo") > 0).alias("lacking"), F.count_if(~plain).alias("special")).first()
    first = F.col("place").eqNullSafe(F.col("first"))
    if sizes["special"] <= min(sizes["lacking"], BROADCAST_BLOBS):
        special = F.broadcast(blobs.where(~plain).select("blob", "first", "todo"))
        todo = texts.join(special, "blob", "left").where(F.col("first").isNull() | (first & (F.size("todo") > 0))).select("body", "blob", F.coalesce("todo", every).alias("todo"))
    else:
        lacking = blobs.where(F.size("todo") > 0).select("blob", "first", "todo")
        todo = texts.join(F.broadcast(lacking) if sizes["lacking"] <= BROADCAST_BLOBS else lacking, "blob").where(first).select("body", "blob", "todo")
    return todo.mapInArrow(_scanner(rules), f"blob string, rule {_RULE}, spans {_SPANS}")


def _joined(places: DataFrame, entries: DataFrame, rules: tuple[Rule, ...], id_cols: tuple[str, ...]) -> DataFrame:
    """All places with the spans that the entries have for their blobs."""
    usable = entries.where(F.array_contains(_every(rules), F.col("rule")) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    spans = F.array_sort(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_blob = checkpointed(usable.groupBy("blob").agg(spans.alias("spans")))
    if by_blob.count() <= BROADCAST_FINDINGS:
        by_blob = F.broadcast(by_blob)
    out = places.join(by_blob, "blob", "left")
    return out.select(*(F.col("place")[f"id{i}"].alias(c) for i, c in enumerate(id_cols)), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> Scan:
    """Scans the versions whose blob and rule version are not in the ledger, and joins findings to all versions.

    `versions` has a row per path and version, named by id_cols; `ledger` has
    the entries of earlier scans.  findings has id_cols, blob (the content's
    SHA-256 in hex) and spans, an array of (kind, start, end) in code points,
    the end exclusive, by start and then in the rules' order.

    A null text is the empty blob.  Null and repeated ids are kept, each row
    with its own findings.  Entries of rules that are not asked for are left
    out, and repeated entries count once.  No rows give no rows.  Other columns
    are not read.
    """
    texts = _texts(versions, id_cols, text_col)
    places = checkpointed(texts.select("place", "blob"))
    known = None if ledger is None else _known(ledger)
    entries = checkpointed(_unseen(texts, places, known, rules))
    return Scan(_joined(places, entries if known is None else entries.unionByName(known), rules, id_cols), entries)


def scan_with_ledger(spark: SparkSession, versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The findings of scan(), by way of a ledger in a Parquet table at `path`.

    A path that does not exist is an empty ledger; a table without the columns
    of a ledger is an error.  New entries are appended before findings are read
    from the ledger, so a scan that fails can be run again and reads only what
    is still missing.  Null, empty and repeated rows are as in scan().
    """
    texts = _texts(versions, id_cols, text_col)
    places = checkpointed(texts.select("place", "blob"))
    known = _known(spark.read.parquet(path)) if exists(spark, path) else None
    _unseen(texts, places, known, rules).write.mode("append").parquet(path)
    return _joined(places, _known(spark.read.parquet(path)), rules, id_cols)


def redact(text: str, spans: Column, mark: str = "[secret]") -> Column:
    """The text column with every span, overlapping ones as one, replaced by a mark.

    `spans` are as scan() gives them, in order.  A null text or null spans give
    null, no spans the text itself; the empty text has no spans.
    """
    start = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] + 1 >= state["at"]
        more = F.concat(state["out"], F.substring(F.col(text), state["at"], F.greatest(s["start"] + 1 - state["at"], F.lit(0))), F.when(fresh, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"] + 1).alias("at"), more.alias("out"))

    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substring(F.col(text), state["at"], F.length(F.col(text)))))
