import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomdex.llm import kneser_ney, mixing, packing, simhash, tokens
from loomdex.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
import test_operators as brute  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = "the of and blue river stone walks under quiet morning light over hills slow bird".split()
    clean = [" ".join(r.choices(words, k=r.randint(30, 120))) for _ in range(200)]
    junk = ["".join(r.choices("#%@xqzj0189", k=150)) for _ in range(30)]
    texts = clean + junk + [clean[0], clean[0], clean[1], None, ""]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 230, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality"](spark, docs, folder)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {r["doc_id"] for r in kneser_ney.classify(docs, labels).where("accepted").collect()}
    assert len(kept & set(range(200))) >= 190 and not kept & set(range(200, 230)) and not kept & {233, 234}
    two = stage["near_copies"](spark, one, folder)
    want = {r["doc_id"] for r in simhash.simhash_components(one).where("doc_id = component_id").collect()}
    assert two.columns == docs.columns and sorted(r["doc_id"] for r in two.collect()) == sorted(want) and not want & {230, 231, 232}
    assert stage["near_copies"](spark, one.union(one), folder).count() == len(want)
    three = stage["mixing"](spark, two, folder)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(two, labels).select("doc_id", "copies").collect()}
    assert three.columns == docs.columns and three.count() == sum(copies.values())
    four = stage["packing"](spark, three, folder)
    assert four.columns == packing.pack_documents(three).columns and four.select("doc_id").distinct().count() == sum(c > 0 for c in copies.values())


def test_rows_that_share_an_id_are_judged_one_by_one(spark, folder):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = [r["text"] for r in docs.where("doc_id between 3 and 12").orderBy("doc_id").collect()]
    junk = docs.where("doc_id = 201").first()["text"]
    rows = [(None, t) for t in [*clean[:6], junk]] + [(500, t) for t in [*clean[6:], junk]]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    one = [(r["doc_id"], r["text"]) for r in stage["quality"](spark, docs.unionByName(extra), folder).collect()]
    fine = {t for i, t in one if i is not None and i < 200}
    assert sorted(t for i, t in one if i is None) == sorted(fine & set(clean[:6])) and len(fine & set(clean[:6])) > 1
    assert sorted(t for i, t in one if i == 500) == sorted(fine & set(clean[6:])) and len(fine & set(clean[6:])) > 1
    near = [(3, clean[0]), (5, clean[1]), (5, clean[0]), (None, clean[2]), (None, clean[3]), (None, clean[3]), (None, clean[0])]
    two = stage["near_copies"](spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near], docs.schema), folder)
    assert {(r["doc_id"], r["text"]) for r in two.collect()} == {(3, clean[0]), (5, clean[1]), (None, clean[2]), (None, clean[3])} and two.count() == 4


def test_run_against_brute_force(spark, tmp_path):
    """Quality, near copies, copies and token pieces, each worked out here from the texts."""
    r = random.Random(21)
    words = [f"{a}{b}" for a in ("ri", "sto", "li", "hi", "mor") for b in ("ver", "ne", "ght", "lls", "ning")]
    texts = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(90)] + ["".join(r.choices("#%@xqzj0189", k=80)) for _ in range(10)]
    texts += [texts[0], texts[1] + "\n", None, "", " ".join(r.choices(words, k=4000))]
    ids = [*range(100), 500, None, 502, 503, None]
    toxic = {i for i in range(90) if i % 9 == 0}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(0, 80)] + [(i, 0, 0) for i in range(90, 95)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # quality: perplexities straight from counts
    h = {x["doc_id"]: x["h"] for x in docs.select("doc_id", kneser_ney.draw().alias("h")).collect()}
    train, held = [texts[i] for i in range(80) if h[i] < 2048], [texts[i] for i in range(80) if h[i] >= 2048]
    letters = sorted(set("".join(train)))
    p = brute.model_of([brute.symbols_of(t, letters) for t in train], 1 / (len(letters) + 1))
    steps = sorted(math.ceil(brute.nll_of(t, p, letters) / len(t) / 0.001) for t in held)
    limit = steps[math.ceil(0.99 * len(steps)) - 1] * 0.001
    rows = [(i, t) for i, t in zip(ids, texts) if t and brute.nll_of(t, p, letters) / len(t) <= limit]
    assert 80 < len(rows) < 100
    # near copies: all pairs of fingerprints
    fp = [brute.slow_fingerprint(t) for _, t in rows]
    up = brute.components_of(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    first = {}
    for n, (i, _) in enumerate(rows):
        first[up[n]] = min(first.get(up[n], (True, 0, n)), (i is None, i or 0, n))
    kept = sorted(((rows[n][0], rows[n][1]) for _, _, n in first.values()), key=str)
    stage = dict(corpus_pipeline.STAGES)
    two = stage["near_copies"](spark, stage["quality"](spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(((x["doc_id"], x["text"]) for x in two.collect()), key=str) == kept
    # mixing: a dense solver over the posteriors
    label_rows = spark.read.parquet(f"{tmp_path}/labels.parquet")
    soft = mixing.mix(two, label_rows).collect()
    domains = sorted({*mixing.TARGETS, "q0t0", "q1t0", "q1t1"})
    post, tok = np.array([x["post"] for x in soft]), np.array([float(len(x["text"].split())) for x in soft])
    goal, w, rate = np.array([mixing.TARGETS[d] for d in domains]), tok / tok.sum(), np.ones(len(soft))
    for _ in range(100_000):
        rate = np.maximum(0, rate - 0.5 * (post @ (post.T @ (w * rate) - goal) + 1e-4 * (rate - 1)))
    assert np.abs(np.array([x["rate"] for x in soft]) - rate).max() < 5e-3
    assert all(x["copies"] in (math.floor(x["rate"]), math.floor(x["rate"]) + 1) for x in soft)
    # packing: whole texts by the tokenizer, none lost
    want = {}
    encoder = tokens.encoder(packing.VOCABULARY).whole
    for x in soft:
        for _ in range(x["copies"]):
            own = encoder.encode(x["text"], add_special_tokens=False).ids + [0]
            for a in range(0, len(own), 2048):
                key = (x["doc_id"], a, len(own[a : a + 2048]), zlib.crc32(np.array(own[a : a + 2048], "<u4").tobytes()))
                want[key] = want.get(key, 0) + 1
    got = {}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for x in out:
        key = (x["doc_id"], x["start"], x["length"], x["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    used = {}
    for x in out:
        used[x["sequence_id"]] = used.get(x["sequence_id"], 0) + x["length"]
    assert max(used.values()) <= 2048 and len(used) == -(-sum(used.values()) // 2048)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false").withColumn("fp", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert len(QUERIES) == 10 and set(ORACLES) <= set(QUERIES)
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
