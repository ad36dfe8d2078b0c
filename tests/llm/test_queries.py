"""The registered queries on the smallest tables: contract columns, oracles, the pipeline."""

import collections
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fareshift.llm import quality, queries
from fareshift.llm.common import id_fold, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")
COLUMNS = {
    "op1_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_kneser_ney": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                      "base_score double, score double",
    "op7_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text string",
    "op9_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                         "contaminated boolean",
    "op10_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op11_fill_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                        "output_sha256 string, restored_sha256 string",
    "op12_resample": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
                    "offset bigint",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert [f"{c} {types[c]}" for c in df.columns][:COLUMNS[name].count(",") + 1] == COLUMNS[name].split(", ")
    got = df.collect()
    if name != "op10_topk":
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in table(spark, SF, "documents").select("doc_id").collect()}
    if name in queries.ORACLES:
        cur = duck.execute(queries.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert collections.Counter(cur.fetchall()) == collections.Counter(tuple(r[c] for c in cols) for r in got)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    found = queries.op1_language(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    scored = queries.op2_quality(spark, SF).where("held_out").join(table(spark, SF, "labels"), "doc_id")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def one_by_one(model, x):
    """The score of one row, tree by tree and node by node."""
    raw = model["bias"]
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        raw += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-raw))


def test_pipeline_filters_rows_without_and_with_repeated_ids(spark):
    schema = table(spark, SF, "documents").schema
    passage = max((r["text"] for r in table(spark, SF, "benchmark").collect()), key=len)
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")

    def stage(f, rows):
        docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema)
        return collections.Counter((r["doc_id"], r["text"], r["source"]) for r in f(spark, docs, SF).collect())

    rows = [(1, a, "s"), (None, a, "s"), (2, b, "t"), (2, b, "s"), (2, c, "s"), (None, c + " x", "s"), (3, "", "s"), (3, "", "s"),
            (None, "y " + passage, "s"), (None, "y " + passage, "s")]
    assert stage(corpus_pipeline.drop_near_duplicates, rows) == collections.Counter(
        [(1, a, "s"), (2, b, "s"), (2, c, "s"), (3, "", "s"), (3, "", "s"), (None, "y " + passage, "s")])
    rows = [(None, "x " + passage, "s"), (5, passage + " z", "s"), (5, a, "s"), (None, b, "s"), (None, "", "s")]
    assert stage(corpus_pipeline.drop_contaminated, rows) == collections.Counter([(5, a, "s"), (None, b, "s"), (None, "", "s")])
    rows = [(None, a + "\n" + b, "s"), (4, a, "s"), (4, a, "t"), (4, c + "\n" + a, "s"), (None, a, "s")]
    assert stage(corpus_pipeline.drop_repeated_lines, rows) in [collections.Counter(x) for x in (
        [(None, b, "s"), (4, a, "s"), (4, a, "t"), (4, c, "s")], [(None, b, "s"), (4, c + "\n" + a, "s")])]


def test_pipeline_stages_do_what_brute_force_does(spark):
    """Each stage on what its predecessor kept."""
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == docs.columns
    labels = table(spark, SF, "labels").where(id_fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(quality.statistics(docs), labels)
    kept = {r["doc_id"]: r for r in good.collect()}
    for i, r in before.items():
        raw = r["text"].encode()
        x = quality.text_statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert (i in kept) == (one_by_one(model, x) >= queries.QUALITY_CUT)
    assert all(kept[i] == before[i] for i in kept)

    lines = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, good, SF).collect()}
    term, seen = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+"), []
    for i in sorted(kept):
        own = []
        for line in kept[i]["text"].split("\n"):
            s = frozenset(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in term.findall(line))
            if not s or not any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                own.append(line)
            if s:
                seen.append(s)
        text = "\n".join(own)
        if term.search(text) or text == kept[i]["text"]:
            assert (lines[i]["text"], lines[i]["n_chars"]) == (text, len(text))
        else:
            assert i not in lines

    deduped = spark.createDataFrame(list(lines.values()), docs.schema)
    single = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, deduped, SF).collect()}
    word, sets, group = re.compile(r"[^\x20\x09-\x0D]+"), {}, {}
    for i in sorted(lines):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in word.findall(lines[i]["text"])]
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        group[i] = i
        for j in list(group):
            if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    assert single == {i for i, g in group.items() if i == g}

    rest = deduped.where(F.col("doc_id").isin([*single]))
    clean = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, rest, SF).collect()}
    items = [term.findall(r["text"].lower()) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[s:s + 10]) for w in items if w for s in range(max(1, len(w) - 9))}
    widths = {len(x) for x in windows}
    for i in single:
        w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in term.findall(lines[i]["text"])]
        hit = any(tuple(w[p:p + n]) in windows for n in widths for p in range(len(w) - n + 1))
        assert (i in clean) != hit

    final = corpus_pipeline.tokenise(spark, deduped.where(F.col("doc_id").isin([*clean])), SF)
    whole = final.join(deduped.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("want")), "doc_id")
    assert whole.count() == len(clean) and whole.where("want <> decoded_sha256").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
