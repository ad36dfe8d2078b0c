"""Secret scans with an incremental blob ledger.

Every historical version of a text is addressed by the SHA-256 of its content
(its blob). The ledger is an append-only Parquet table with one row per scan:
blob, the rule versions applied, the findings. A run

1. addresses all versions and picks one version per blob,
2. subtracts what the ledger already holds, per blob and rule version,
3. scans only the rest (one copy of each blob, only its unseen rules),
4. appends to the ledger and joins the findings back to all paths.

The ledger may hold a row more than once (a retried append, a repeated version
row): reading it merges the rows of a blob, so the findings do not change.

Defined results: a null text is the empty blob, which has no findings; a null
path is a path like any other; repeated version rows each get their result row;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareshift.llm.common import materialize, sub_batches


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``least`` is the shortest length of ``group`` that
    counts; shorter matches are consumed but dropped. ``version`` changes
    whenever the rule does, which makes every blob unseen for it again."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False
    base: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         8, group=2, ignore_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]+", 32, base=True),
)
# Further kinds of this scanner; they only add spans.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("hosttoken", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("urlauth", r"://[^\s/:@]++:([^\s/:@]++)@", 3, group=1, version=3),
)
RULES = BASE_RULES + EXTRA_RULES

FINDINGS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([
    T.StructField("blob", T.BinaryType()), T.StructField("rules", T.ArrayType(T.StringType())),
    T.StructField("findings", FINDINGS)])
_ARROW_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


# A run of 32 hex digits starts where no hex digit stands before it; looking for
# the 32nd digit first skips most of a text. It finds the same maximal runs.
_FAST = {"[0-9a-f]+": lambda least: r"(?<![0-9a-f])[0-9a-f]{%d,}" % least}


def compile_rule(rule: Rule):
    pattern = _FAST[rule.pattern](rule.least) if rule.pattern in _FAST else rule.pattern
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def find(text: str, rules) -> list[dict]:
    """Leftmost non-overlapping matches of each (rule, compiled pattern);
    positions are code points, the end is exclusive."""
    out = []
    for rule, compiled in rules:
        for m in compiled.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append({"kind": rule.kind, "start": m.start(), "end": m.end()})
    return out


def _scanner(rules):
    def scan(batches):
        compiled = {r.key: (r, compile_rule(r)) for r in rules}
        for batch in sub_batches(batches):
            found = []
            todo_of = batch.column("rules").to_pylist()
            for text, todo in zip(batch.column("text"), todo_of, strict=True):
                found.append(find(text.as_py() or "", [compiled[k] for k in todo]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("rules"), pa.array(found, _ARROW_FINDINGS)],
                names=["blob", "rules", "findings"])
    return scan


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _by_blob(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"),
        F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))


def scan_versions(versions: DataFrame, ledger_path: str, path_col: str = "path", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, extend the ledger, and return
    (path, blob, findings) for every row of ``versions``."""
    spark = versions.sparkSession
    v = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    v = v.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    paths = v.select("path", "blob")
    wanted = F.array(*[F.lit(r.key) for r in rules])
    seen = _by_blob(read_ledger(spark, ledger_path)).select("blob", "seen")
    todo = (paths.groupBy("blob").agg(F.min("path").alias("rep"))
            .join(seen, "blob", "left")
            .select("blob", "rep",
                    F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
            .where(F.size("rules") > 0))
    # One version of each unseen blob meets its text by its own path, so a blob
    # with very many copies moves one text only and no key is hot.
    text = v.select(F.col("path").alias("rep"), F.col("blob").alias("at"), "text")
    scanned = (text.join(todo, text["rep"].eqNullSafe(todo["rep"]) & (text["at"] == todo["blob"]))
               .select("blob", "rules", "text")
               .mapInArrow(_scanner(rules), LEDGER))
    scanned.write.mode("append").parquet(ledger_path)

    kinds = F.array(*[F.lit(r.kind) for r in rules])
    # Written first, so that the join below has two plain exchanges and Spark can split a blob with very many paths.
    ledger = materialize(_by_blob(read_ledger(spark, ledger_path)).select(
        "blob", F.filter("findings", lambda f: F.array_contains(kinds, f["kind"])).alias("findings")), "secret-findings")
    return paths.join(ledger, "blob", "left").select("path", "blob", "findings")
