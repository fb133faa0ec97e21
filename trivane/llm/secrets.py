"""Secret scans over every version of every text, each distinct content scanned once per rule version.

Contents are addressed by their SHA-256.  A ledger on shared storage records which (blob, rule, rule version) triples
have been scanned and what they gave; a scan works on the unseen ones only and joins findings back to all paths.
Everything is DataFrame functions: the positions of matches follow from the lengths of the texts between them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.session import new_step_dir


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; matches whose measured part is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


# The base rules in the order in which ties of start are listed, then the rules this module adds.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
)
RULES = BASE + ADDED

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
FINDING = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def _matches(text: Column, rule: Rule) -> Column:
    """Spans (start, end) of one rule in code points: leftmost, non-overlapping, long enough.

    ``split`` gives the texts between the matches and ``regexp_extract_all`` the matches, both by the same search.
    Hits are looked for first with one test, so a text without any costs a single pass.
    """
    pattern = F.lit(rule.pattern)
    # A run of at least `least` characters is the same as a run that is then found long enough, for one-group rules.
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.split(text, rule.pattern, -1).alias("before"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + F.length(row["before"])
        end = begin + F.length(row["whole"])
        hit = F.when(
            F.length(row["part"]) >= rule.least,
            F.array(F.struct(begin.alias("start"), end.alias("end"))),
        ).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
        return F.struct(end.alias("at"), F.concat(state["out"], hit).alias("out"))

    # The last text has no match after it.
    found = F.aggregate(F.slice(rows, 1, F.size(whole)), start, step, lambda state: state["out"])
    quick = _quick(rule)
    return F.when(text.rlike(quick), found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def _quick(rule: Rule) -> str:
    """A pattern that finds something in every text with a span of the rule, and little else."""
    if rule.kind == "hex":
        return "[0-9a-f]{%d}" % rule.least
    if rule.kind == "access":
        return "AKIA[A-Z0-9]{%d}" % (rule.least - 4)
    return rule.pattern


class Ledger:
    """Scanned (blob, kind, version) triples and their spans: one folder per committed batch.

    A batch is written under its own name and counts once its folder holds the success marker, so a new session over the
    same folder knows what has been scanned, and a half-written batch is scanned anew.  Writing a batch again replaces
    the same folder, so a batch that is run twice is there once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self._spark = spark
        self._folder = folder or new_step_dir(spark, "ledger")

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        jvm = self._spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self._folder)
        system = root.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return sorted(n for n in names if system.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def findings(self, without: str | None = None) -> DataFrame:
        """(blob, kind, version, spans) of every scanned triple, but for those of one batch; spans may be empty."""
        done = [b for b in self.batches() if b != without]
        if not done:
            return self._spark.createDataFrame([], FINDING)
        return self._spark.read.schema(FINDING).parquet(*[f"{self._folder}/{b}" for b in done])

    def commit(self, batch: str, found: DataFrame) -> None:
        """Write a batch; ``found`` must not read the batch's own folder, which is replaced."""
        if "/" in batch:
            raise ValueError(f"a batch is one folder: {batch}")
        found.write.mode("overwrite").parquet(f"{self._folder}/{batch}")


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``blob``, the SHA-256 of the text; null is the empty text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def scan(
    versions: DataFrame,
    ledger: Ledger,
    batch: str,
    rules: Sequence[Rule] = RULES,
    path_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Scan what the ledger hasn't seen, commit it, and return one row per path: path_cols, blob, spans.

    ``versions`` holds one row per path and version (any columns may tell them apart; all are in ``path_cols``).
    spans is an array of (start, rank, kind, end) in code points, end exclusive, by start and then by the rule's place
    in ``rules``.  Null texts are empty.  Rows that repeat are returned as often.  An empty table gives an empty result.

    Each content travels once: copies are reduced to one text before the shuffle, so a group of copies that holds a
    third of the rows is no hot key.  The join back to the paths has blobs as its keys and carries no text.
    """
    rank = {rule.kind: i for i, rule in enumerate(rules)}
    paths = versions.select(
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(path_cols)], F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    paths = paths.withColumn("blob", F.sha2("text", 256))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    # A batch that is run again is replaced, so its own triples aren't taken as seen.
    others = any(b != batch for b in ledger.batches())
    done = ledger.findings(without=batch).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    known = F.coalesce(F.col("done"), F.expr("cast(array() as array<string>)"))
    unseen = blobs.join(done, "blob", "left") if others else blobs.withColumn("done", F.lit(None).cast("array<string>"))
    found = F.array(
        *[
            F.when(
                ~F.array_contains(known, f"{rule.kind}:{rule.version}"),
                F.struct(
                    F.lit(rule.kind).alias("kind"),
                    F.lit(rule.version).alias("version"),
                    _matches(F.col("text"), rule).alias("spans"),
                ),
            )
            for rule in rules
        ]
    )
    # One row per blob and rule is written; blobs where nothing was found need one small row each as a proof of work.
    scanned = unseen.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    ledger.commit(batch, scanned.select("blob", "f.kind", "f.version", "f.spans"))

    wanted = F.lit(False)
    for rule in rules:
        wanted = wanted | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    hits = (
        ledger.findings()
        .filter(wanted & (F.size("spans") > 0))
        .withColumn("rank", ranks[F.col("kind")])
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.flatten(
                    F.collect_list(
                        F.transform(
                            "spans",
                            lambda s: F.struct(
                                s["start"].alias("start"), F.col("rank"), F.col("kind"), s["end"].alias("end")
                            ),
                        )
                    )
                )
            ).alias("spans")
        )
    )
    out = paths.drop("text").join(hits, "blob", "left")
    return out.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(path_cols)],
        "blob",
        F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"),
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by a mark; overlapping spans are replaced together."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        kept = F.when(
            span["start"] >= state["at"],
            F.concat(
                state["out"],
                F.substring(text, state["at"] + 1, span["start"] - state["at"]),
                F.lit("[secret]"),
            ),
        ).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), kept.alias("out"))

    return F.aggregate(
        spans, none, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    )
