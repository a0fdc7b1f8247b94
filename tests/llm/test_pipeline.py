"""The pipeline's stages, one after another, on the smallest documents."""

import re

import corpus_pipeline as P
from tidemark.llm import minhash_join

SF = "/root/testdata/sf0.001"


def without_repeats(texts):
    """Texts without the words of 50-word windows that a smaller id has; one that loses none stays as it is."""
    first, want = {}, {}
    found = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in sorted(texts.items())}
    for i, w in found.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in found.items():
        gone = {k + n for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for n in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        if kept or not gone:
            want[i] = kept if gone else texts[i]
    return want


def test_stages_keep_and_drop(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name.replace(" ", "-")))
        before, docs = docs, spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == names and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        if name == "repeated passages":
            assert {r.doc_id: r.text for r in docs.collect()} == without_repeats({r.doc_id: r.text for r in before.collect()})
            last = docs
        if name == "near duplicates":
            assert minhash_join.near_duplicates(docs).where("NOT kept").count() == 0
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = spark.read.parquet(f"{SF}/documents.parquet").join(good, "doc_id").count()
    judged = spark.read.parquet(str(tmp_path / "quality-rules")).join(good, "doc_id").count()
    assert judged >= 0.95 * clean
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.quality_rules(spark, last.limit(0), SF).count() == 0


def test_repeated_passages_by_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    lists = {
        1: words[:120], 2: words[20:75] + ["own", "end"], 3: words[60:110], 4: ["x"] + words[0:49] + ["y"], 5: words[200:260] * 2, 6: words[205:255] + ["z"],
        7: words[0:60] + ["gap"] + words[60:115] + ["tail"],
    }
    want = without_repeats({i: " ".join(w) for i, w in lists.items()})
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in lists.items()], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in P.repeated_passages(spark, docs, SF).collect()} == want
    assert 3 not in want and want[2] == "own end" and want[7] == "gap tail"


def test_stages_on_odd_rows(spark):
    text = "the quick brown fox and the lazy dog are here to see that it is not as it was in the day " + " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en"), (1, text, "en"), (2, text, None), (None, text, "en"), (3, None, "en"), (4, "", "en"), (5, "12 34", None)]
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    assert ids(P.quality_rules(spark, docs, SF)) == [1, 1, 2, None]
    assert ids(P.language_id(spark, docs, SF)) == [1, 1, 2, None]
    assert ids(P.near_duplicates(spark, docs, SF)) == [1, 1, 3, 4, 5, None]
    assert ids(P.repeated_passages(spark, docs, SF)) == [1, 1, 3, 4, 5, None]
    assert set(ids(P.pack(spark, docs, SF))) == {1, 2, 3, 4, 5, None}
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
