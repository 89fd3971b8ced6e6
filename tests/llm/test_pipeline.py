from tokenizers import Tokenizer

import corpus_pipeline
from concord.llm import decontamination, language_id, quality_rules, simhash
from concord.llm.queries import vocabulary_path
from concord.session import table


def test_stages_follow_each_other(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels, benchmark = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("kept").collect()}
    one = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in one.collect()} == kept
    known = language_id.identify(one)
    two = corpus_pipeline.language(spark, one, sf_dir).cache()
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in known.where("lang_pred <> 'und' and score >= 0.5").collect()}
    three = corpus_pipeline.near_duplicates(spark, two, sf_dir).cache()
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({r["component_id"] for r in simhash.near_duplicates(two).collect()})
    four = corpus_pipeline.contamination(spark, three, sf_dir).cache()
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in decontamination.contamination(three, benchmark).where("not contaminated").collect()}
    assert all(x.columns == docs.columns for x in (one, two, three, four))
    five = corpus_pipeline.packed(spark, four, sf_dir)
    ids = {r["doc_id"] for r in five.where("piece = 0").collect()}
    assert ids == {r["doc_id"] for r in four.collect()} and 0 < len(ids) < 200
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in run.collect()} == ids and run.columns == five.columns


def test_a_run_against_brute_force(spark, sf_dir):
    """What a run packs, worked out document by document with the plain rules that hold each operator in its own test."""
    from tests.llm import test_decontamination, test_quality_rules, test_simhash

    docs = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = []
    for r in docs:
        words, _, _, _, hit = test_quality_rules.brute(r["text"])
        if words >= 50 and 100 * hit <= 50 * words:
            kept.append(r)  # the few labels of the smallest tables certify no cutoff
    one = spark.createDataFrame(kept, table(spark, sf_dir, "documents").schema)
    model = language_id.train(one)
    known = []
    for r in kept:
        lang, score = model.predict(r["text"].encode())
        if lang != "und" and score >= 0.5:
            known.append(r)
    roots = test_simhash.brute_components([test_simhash.brute_fingerprint(r["text"]) for r in known])
    first = [r for i, r in enumerate(known) if roots[i] == i]
    wanted = {r["doc_id"] for r in first if not test_decontamination.brute(r["text"], items)[4]}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in found} == wanted and len(known) > len(first) >= len(wanted) > 50
    tokenizer = Tokenizer.from_file(vocabulary_path())
    for r in first:
        if r["doc_id"] in wanted:
            n = len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
            mine = sorted((x["piece"], x["start"], x["length"]) for x in found if x["doc_id"] == r["doc_id"])
            assert mine == [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_run_leaves_only_what_its_result_reads(spark, sf_dir):
    from concord.session import ensure_checkpoint_dir, remove

    def folders():
        path = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName().split("-")[0] in ("pipeline", "table")}

    before = folders()
    corpus_pipeline.run(spark, sf_dir)
    left = folders() - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-")
    remove(spark, f"{ensure_checkpoint_dir(spark)}/{left.pop()}")


def test_stages_take_odd_rows(spark, odd, empty, crowded_names, sf_dir):
    for docs in (odd, crowded_names):
        kept = {name: stage(spark, docs, sf_dir) for name, stage in corpus_pipeline.STAGES}
        assert kept["quality rules"].count() == 0  # all are short, or one passage over and over
        assert kept["language ID"].count() <= 6  # four have no letter
        assert sorted((r["doc_id"] for r in kept["near-duplicates"].collect()), key=str) == [1, 4, 5, 7, None]
        assert sorted(map(str, (r["doc_id"] for r in kept["decontamination"].collect()))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
        assert kept["packing"].where("piece = 0").count() == 10
        assert all(kept[name].columns == docs.columns for name in list(kept)[:-1])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
