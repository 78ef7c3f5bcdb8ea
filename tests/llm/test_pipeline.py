"""The pipeline's stages on a small corpus, each on what its predecessor kept."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        out.append((name, docs))
    return out


def test_order_and_columns(spark, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "long_repeats", "packing"]
    names = spark.read.parquet(f"{DIR}/documents.parquet").columns
    assert all(df.columns == names for _, df in kept)


def test_filters_take_effect_and_keep_clean_documents(spark, kept):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    clean = labels.where("toxic = 0 and quality = 1")
    after = dict(kept)["quality"]
    assert after.join(clean, "doc_id").count() >= 0.97 * clean.count()
    assert after.join(labels.where("quality = 0"), "doc_id").count() <= 2


def test_one_of_each_group_stays(kept):
    before, after = dict(kept)["quality"], dict(kept)["near_copies"]
    assert after.count() == after.select("text").distinct().count()
    assert {r.text for r in after.select("text").collect()} <= {r.text for r in before.select("text").collect()}
    first = before.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert after.join(first, ["text", "doc_id"], "left_anti").count() == 0


def test_repeats_are_cut(kept):
    seen: set[bytes] = set()
    rows = dict(kept)["near_copies"].orderBy("doc_id").collect()
    cut = {r.doc_id: r.text for r in dict(kept)["long_repeats"].collect()}
    assert set(cut) == {r.doc_id for r in rows}
    for r in rows:
        b = r.text.encode()
        own = {b[k : k + 50] for k in range(len(b) - 49)}
        if not own & seen:
            assert cut[r.doc_id] == r.text
        else:
            assert len(cut[r.doc_id]) < len(r.text)
        seen |= own


def test_last_stage_packs_all(spark, kept):
    out = corpus_pipeline.STAGES[-1][1](spark, kept[-1][1], DIR)
    assert out.select("doc_id").distinct().count() == kept[-1][1].count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def key(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def jaccard_groups(rows):
    """Rows grouped by all links of five-word similarity of 0.8 or more, and by equal doc_id and text."""
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def folder(spark, edge, labels, tmp_path_factory):
    """A folder with the edge table, whose extra columns the stages leave, and its labels."""
    path = str(tmp_path_factory.mktemp("sf"))
    edge.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_toxicity_and_quality_stages_on_the_edge_table(spark, edge, folder):
    from millrace.llm import quality, toxicity

    docs = edge.select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.training_split())
    table = toxicity._table(model.lexicon)
    rows = docs.collect()
    want = Counter(key(r) for r in rows if model.score(toxicity.text_features([(r.text or "").encode()], table))[0] < 0.7)
    assert Counter(map(key, corpus_pipeline.drop_toxic(spark, edge, folder).collect())) == want
    model = quality.fit(docs, labels, F.lit(True))
    evidence = [float(model.evidence([(r.text or "").encode()])[0]) for r in rows]
    score = brute_quality([(r.source, r.lang, e) for r, e in zip(rows, evidence)])
    assert Counter(map(key, corpus_pipeline.drop_poor(spark, edge, folder).collect())) == Counter(key(r) for r, s in zip(rows, score) if s >= 0.5)


def brute_quality(rows):
    """Scores of (host, path, evidence) rows by the formulas of the operator, row by row."""
    hosts, paths = {}, {}
    for h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    rate = sum(e for _, _, e in rows) / len(rows)

    def weight(rates):
        spread = np.mean([(r - m) ** 2 for r, m, _ in rates])
        chance = np.mean([m * (1 - m) / n for _, m, n in rates])
        return min(max(np.mean([m * (1 - m) for _, m, _ in rates]) / max(spread - chance, 1e-6), 10.0), 10_000.0)

    a = weight([(np.mean(x), rate, len(x)) for x in hosts.values()])
    shrunk = {h: (sum(x) + a * rate) / (len(x) + a) for h, x in hosts.items()}
    b = weight([(np.mean(x), shrunk[h], len(x)) for (h, _), x in paths.items()])

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return np.log(p / (1 - p))

    out = []
    for h, p, e in rows:
        host = (sum(hosts[h]) - e + a * rate) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, p]) - e + b * host) / (len(paths[h, p]) - 1 + b)
        out.append(1 / (1 + np.exp(-(logit(e) + logit(path) - logit(rate)))))
    return out


def test_quality_formulas(spark, edge, labels):
    from millrace.llm import quality

    got = quality.with_quality(edge, labels, F.col("source"), F.col("lang")).collect()
    want = brute_quality([(r.source, r.lang, r.evidence) for r in got])
    assert [r.quality_score for r in got] == pytest.approx(want, abs=1e-9)


def test_near_copy_stage_on_the_edge_table(spark, edge, folder):
    rows = [r for r in edge.select(*corpus_pipeline.COLUMNS).collect() if r.doc_id is None or r.doc_id != 11]  # all but the longest, which the pairs below would take long for
    docs = spark.createDataFrame(rows, edge.select(*corpus_pipeline.COLUMNS).schema)
    known = [r for r in rows if r.doc_id is not None]
    groups = {}
    for r, g in zip(known, jaccard_groups(known)):
        groups.setdefault(g, []).append(r)
    got = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    assert Counter(key(r) for r in got if r.doc_id is None) == Counter(key(r) for r in rows if r.doc_id is None)
    left = [r for r in got if r.doc_id is not None]
    assert len(left) == len(groups)
    for members in groups.values():
        first = min(r.doc_id for r in members)
        mine = [r for r in left if key(r) in {key(m) for m in members}]
        assert len(mine) == 1 and mine[0].doc_id == first


def test_rows_of_one_id_are_decided_one_by_one(spark, folder):
    texts = {"A": "the first of all the texts here", "B": "something that is not like any other", "C": "a third one stands on its own"}
    rows = [(3, "A"), (7, "A"), (7, "B"), (7, "B"), (9, "C")]
    docs = spark.createDataFrame([(d, texts[t], "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, texts["A"]), (7, texts["B"]), (9, texts["C"])]


def test_whole_pipeline_on_edge_and_empty_tables(spark, edge, empty, labels, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.where("doc_id is null").count() > 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
