"""Each stage of the pipeline against a plain version on its own input, and the whole run on a table."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from jobtide.llm import jaccard, langid, pii
from jobtide.llm.common import CLEANUP_CONF, made, written
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        f(spark, docs, SF).write.parquet(str(top / name))
        out.append((docs.collect(), docs := spark.read.parquet(str(top / name))))
    return [(a, b.collect()) for a, b in out]


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard", "suffix_dedup", "pii", "packing"]


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    assert len(after) >= 0.99 * len(before) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and list(after[0].asDict()) == COLUMNS


def test_language_drops_what_resembles_none(spark):
    rng = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz   ", "абвгдежзийклмнопрстуфхцчшщъыьэюя   ", "กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธน   "]
    junk = [(-1 - i, "".join(rng.choices(letters[i % 4], k=200 + 20 * i)), None) for i in range(20)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    kept = {r["doc_id"] for r in cp.language(spark, docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string")), SF).collect()}
    assert not [i for i in kept if i < 0] and len(kept) >= 0.99 * docs.count()


def test_near_copies(stages):
    before, after = stages[1]
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in before], 80, 5)
    assert {r["doc_id"] for r in after} == {i for i, _, c in groups if i == c}
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_near_copies_of_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (5, a + " end"), (5, b), (7, b + " end"), (8, "some other text of no group")]
    kept = cp.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[0], rows[2], rows[4]]


def test_repeats(stages):
    before, after = stages[2]
    want = {i: h for i, *_, h in brute.suffix([(r["doc_id"], r["text"]) for r in before])}
    kept = {r["doc_id"]: r["text"] for r in after}
    assert kept.keys() == want.keys()
    assert sum(hashlib.sha256(kept[i].encode()).hexdigest() == want[i] for i in want) >= 0.98 * len(want)  # but for cut characters
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_personal_data(stages):
    before, after = stages[3]
    kept = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        assert kept[r["doc_id"]] == pii.redact(r["text"], pii.find(r["text"]))
        assert not any(k == "email" for k, *_ in brute.pii(kept[r["doc_id"]]))


def test_packing_covers_all(stages):
    before, after = stages[4]
    total = {r["doc_id"]: r["doc_tokens"] for r in after}
    assert total.keys() == {r["doc_id"] for r in before}
    for i, n in total.items():
        assert sum(r["length"] for r in after if r["doc_id"] == i) == n


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (None, "the end of the road", "en", None, 1), (1, "the end of it all", "en", "s", 1), (1, "the end of it all", "en", "s", 1), (1, "another text with this id", "en", "s", 1), (2, "THE end of it all", None, "s", 1), (3, "", "en", "s", 1), (4, "12 34 !", "en", "s", 1), (5, "x" * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"t": F.lit("a"), "copy": F.lit(1), "marks": F.lit(2)})
    first = cp.language(spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} <= {None, 1, 2, 5}
    kept = cp.near_copies(spark, docs, SF).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] == 1) == ["another text with this id", "the end of it all"] and not [r for r in kept if r["doc_id"] == 2]
    assert len([r for r in kept if r["doc_id"] is None]) == 2
    for stage in (cp.repeats, cp.personal_data):
        assert stage(spark, docs, SF).count() == len(rows)
    assert cp.packed(spark, docs, SF).count() >= len(rows)
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert langid.prototypes(none.select("doc_id", "text", "lang")) == {}


def test_a_very_long_text(spark, tmp_path):
    rng = random.Random(8)
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(50).collect() for w in r["text"].split(" ")]
    long = " ".join(rng.choices(words, k=120_000))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(7000, long, None), (7001, long + " more", None)], "doc_id long, text string, lang string"))
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).where("doc_id >= 7000").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ({7000, 7001} if k == 0 else {7000})
    assert docs.agg(F.sum("length")).first()[0] == docs.first()["doc_tokens"] > 120_000


def test_run(spark, stages):
    before = set(made())
    rows = cp.run(spark, SF).collect()
    assert {(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] is not None} and {r["doc_id"]: r["doc_tokens"] for r in rows} == {r["doc_id"]: r["doc_tokens"] for r in stages[4][1]}
    assert len(set(made()) - before) <= 1  # only the result is left


def shuffle_bytes(spark, known=()):
    """{file: bytes} of the shuffle files on this machine's disk that are not ``known``."""
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f): f.stat().st_size for top in tops for f in Path(top).rglob("shuffle_*") if f.exists() and str(f) not in known}


def left_after(spark, known, most):
    """Bytes of new shuffle files once they are at most ``most``, or after ten seconds: Spark deletes them in the background."""
    for _ in range(50):
        if (left := sum(shuffle_bytes(spark, known).values())) <= most:
            break
        time.sleep(0.2)
    return left


def test_written_tables_leave_no_shuffle_files(spark):
    """Finding of round 2: shuffle files of all of a stage's queries stood on disk together."""
    was, known = spark.conf.get(CLEANUP_CONF, None), shuffle_bytes(spark)
    counts = spark.range(100_000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")).orderBy("k")
    table = written(counts)
    assert left_after(spark, known, 0) == 0
    # what made the table can run again, also by a plain query, whose files are its own affair
    assert [tuple(r) for r in table.orderBy("k").collect()] == [tuple(r) for r in counts.collect()] == [tuple(r) for r in written(counts).orderBy("k").collect()]
    assert spark.conf.get(CLEANUP_CONF, None) == was


def test_near_copies_leave_few_shuffle_files(spark):
    """Finding of round 2: of the signatures' shuffles, which are larger than the texts, nothing is left when the stage's table can be read."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = shuffle_bytes(spark)
    kept = cp.near_copies(spark, docs, SF)
    assert left_after(spark, known, 200_000) <= 200_000
    assert kept.count() == len({r["component_id"] for r in jaccard.jaccard_components(docs, cp.PERCENT, cp.WORDS).collect()})


def test_language_writes_no_table(spark):
    """Finding of round 2: predictions with their texts stood on disk while the next stages ran. Kept is what was kept by them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).unionByName(docs.limit(40).withColumn("text", F.translate("text", "aeiostn", "zqxjvkw")))
    before = made()
    kept = cp.language(spark, docs, SF)
    assert made() == before
    model, damped = langid.fitted(docs.where(~langid.held_out(F.col("doc_id"))))
    told = langid.predict(docs, model, "lang", with_text=True, damped=damped).collect()
    likes = sorted(r["likeness"] for r in told if r["lang"] is not None and not brute.held_out(r["doc_id"]) and r["lang_pred"] != langid.UND)
    low, high = (x / langid.DIM**0.5 for x in langid.LIKE_BOUNDS)
    bound = min(max(likes[int(langid.LIKE_QUANTILE * (len(likes) - 1))], low), high)
    bound = min(max(int(bound * langid.LIKE_STEPS) / langid.LIKE_STEPS, low), high)
    want = [(r["doc_id"], r["text"], r["lang"] or r["lang_pred"]) for r in told if r["lang_pred"] != langid.UND and (r["likeness"] >= bound or len(r["text"]) < cp.SHORT_CHARS)]
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()) == sorted(want) and len(want) > 900
