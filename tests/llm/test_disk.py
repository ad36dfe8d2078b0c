"""What near-duplicate search writes, and how often line dedup goes through a text."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from fareshift.llm import line_dedup, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_sets_are_written_once(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 80))) for _ in range(120)]
    texts += [" ".join(["new", *t.split()[1:]]) for t in texts[:40]] + texts[:10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = []

    def record(df, name, write=ngram_join.materialize):
        written.extend([name] * ("s" in df.columns and "key" in df.columns))
        return write(df, name)

    monkeypatch.setattr(ngram_join, "materialize", record)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, k=5, num=80, den=100).collect()}
    assert written == ["jaccard-sets"]
    # The copies with another first word, and the equal texts, are with their original.
    assert got == {i: i if i < 120 else i - 120 if i < 160 else i - 160 for i in range(170)}


def lambdas(plan: str) -> list[str]:
    """The texts of all lambda functions of a plan."""
    out, at = [], plan.find("lambdafunction(")
    while at >= 0:
        end, depth = at + len("lambdafunction("), 1
        while depth and end < len(plan):
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        out.append(plan[at:end])
        at = plan.find("lambdafunction(", at + 1)
    return out


def test_a_filter_on_the_kept_text_splits_no_text_for_each_line(spark):
    data = [(1, "alpha beta\n!\ngamma", "en", "s", 0), (2, "gamma\nalpha beta", "en", "s", 0), (3, "gamma\nnew", "en", "s", 0),
            (None, "delta\ndelta\nalpha beta", "en", "s", 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, DOCS)
    out = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and lambdas(plan) and not [x for x in lambdas(plan) if "split(" in x]
    got = collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    assert got == collections.Counter([(1, "alpha beta\n!\ngamma", 18), (3, "new", 3), (None, "delta", 5), (4, None, None), (5, "", 0)])


def test_a_document_of_many_repeated_lines(spark):
    """Linear in lines and in lines that go; ids that are structs, as in the pipeline."""
    lines = [f"word{i % 1500} other{i % 1500}" for i in range(3000)]
    data = [(1, "\n".join(lines), "en", "s", 0), (2, "\n".join(lines[:1000] + ["last"]), "en", "s", 0)]
    docs = spark.createDataFrame(data, DOCS).withColumn("key", F.struct("doc_id", "lang"))
    out = line_dedup.dedup_lines(docs, id_col="key").where(F.length("text") > 0)
    got = {r["key"]["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in out.collect()}
    assert got == {1: (3000, 1500, "\n".join(lines[:1500])), 2: (1001, 1000, "last")}


def test_a_line_is_listed_in_one_row(spark, monkeypatch):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    near = [" ".join(["new", *t.split()[1:]]) for t in lines[:20]]
    docs = spark.createDataFrame([(i, "\n".join(part)) for i, part in enumerate((lines[:30], lines[30:], near))],
                                 "doc_id long, text string")
    listed = []

    def record(df, name, write=line_dedup.materialize):
        out = write(df, name)
        if name == "lines-listed":
            listed.extend(out.select("id", "no").collect())
        return out

    monkeypatch.setattr(line_dedup, "materialize", record)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert sorted(listed) == [(i, no) for i, n in enumerate((30, 30, 20)) for no in range(n)]
    assert got == {0: 0, 1: 0, 2: 20}
